import pytest
from pyspark.sql import functions as F

from tessera.functions import patterns
from tessera.functions import scalar as S
from tessera.functions.registry import Functions
from tessera.operators import changes as C
from tessera.operators import dml, setops
from tessera.sources import files
from tessera.streaming import changes as stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "op,a,b,bits,want",
    [("+", 2**31 - 1, 1, 32, -(2**31)), ("*", 2**31 - 1, 2**31 - 1, 32, 1), ("/", -7, 2, 32, -3), ("%", -7, 3, 32, -1), ("/", 1, 0, 32, None), (">>>", -16, 2, 32, 1073741820),
     ("<<", 1, 33, 32, 2), ("+", 2**63 - 1, 1, 64, -(2**63)), ("*", 2**62, 4, 64, 0), ("^", 6, 3, 32, 5), ("/", -(2**31), -1, 32, -(2**31)), ("-", -(2**63), 1, 64, 2**63 - 1)],
)
def test_whole_numbers_wrap_around(spark, op, a, b, bits, want):
    assert value(spark, S.int_op(op, F.lit(a), F.lit(b), bits)) == want


def test_three_kinds_of_null(spark):
    none, one = F.lit(None).cast("double"), F.lit(1.0)
    assert value(spark, none == one) is None
    assert value(spark, S.equal_objects(none, none, True)) is True and value(spark, S.equal_objects(one, one + 1e-11, True)) is True
    assert value(spark, S.equal_objects(none, one, True)) is False
    assert value(spark, S.concat_set(F.lit("a"), none, F.lit("b"))) == "ab" and value(spark, S.concat_raw(F.lit("a"), none)) == "anull"
    assert value(spark, S.ternary(F.lit(None).cast("boolean"), 1, 2)) is None


def test_strings(spark):
    assert value(spark, S.ellipsis(F.lit("a bc def"), 7, True)) == "a bc..."
    assert [value(spark, S.ellipsis(F.lit("abcdef"), n)) for n in (0, 2, 4, 6)] == ["", "..", "a...", "abcdef"]
    assert value(spark, S.insert_linebreaks(F.lit("aa bb cc dddddddd e"), F.lit(5))) == "aa bb\ncc\ndddddddd\ne"
    assert [value(spark, S.format_float(F.lit(x))) for x in (2.0, 2.345, 2.5, -0.126, -0.001, 0.125, float("nan"), float("inf"))] == ["2", "2.35", "2.5", "-0.13", "-0", "0.12", "NaN", "∞"]
    assert value(spark, S.clean_file_name(F.lit("a b..c!.d."))) == "a_b.c.d"
    assert value(spark, S.salted_hash(F.lit("x"), F.lit(b"salt"), weak=True)).isascii()
    joined = [(("a/b", "../c", "/d"), "a/c//d"), (("", None), None), (("a", "../../b"), "/b"), (("a/", "b", ""), "a/b"), (("../x", "y"), "../x/y"), (("a/b/c", "../../d"), "a/d")]
    assert [value(spark, S.url_concat(*x)) for x, _ in joined] == [y for _, y in joined]
    assert value(spark, S.with_element(F.array(F.lit(1), F.lit(2)), 1, F.lit(9))) == [1, 9]


def test_floating_point_division_by_zero(spark):
    show = lambda op, a, b: str(value(spark, S.float_op(op, F.lit(a).cast("double"), F.lit(b).cast("double"))))
    assert [show("/", a, b) for a, b in ((1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (float("inf"), 0.0), (6.0, 4.0))] == ["inf", "-inf", "-inf", "nan", "None", "None", "inf", "1.5"]
    assert [show("%", a, b) for a, b in ((5.5, 0.0), (5.5, 2.0), (-5.5, 2.0), (None, 0.0))] == ["nan", "1.5", "-1.5", "None"]
    assert [value(spark, S.compare(F.lit(a), F.lit(b))) for a, b in ((1, 2), (2, 2), (3, 2), ("a", "b"))] == [-1, 0, 1, -1]


def test_changes_of_one_key_and_lists_with_nulls(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y")], "id int, name string")
    assert sorted(map(tuple, dml.updated(base, twice, ["id"]).collect())) == [(1, "y"), (2, "b")]
    assert sorted(map(tuple, dml.upserted(base, spark.createDataFrame([(2, None), (3, "c")], "id int, name string"), ["id"]).collect()), key=str) == [(1, "a"), (2, None), (3, "c")]
    lists = spark.createDataFrame([(1, None), (1, 5), (None, 5)], "parent int, child int")
    assert dml.list_changes(lists, lists, ["parent", "child"]).collect() == []
    assert [tuple(r) for r in dml.list_changes(lists, lists.where("parent = 1"), ["parent", "child"]).collect()] == [(None, 5, "removed")]


def test_jobs_add_jobs_for_so_many_rounds(spark):
    jobs = spark.createDataFrame([(5, 1), (5, 2), (1, 3)], "priority int, seq long")
    add = lambda round_: round_.where("seq < 400").select("priority", (F.col("seq") + 100).alias("seq"))
    done, waiting = C.run_jobs(jobs, add, 2, 9)
    assert {r.seq: r.round for r in done.collect()} == {100 * k + i: k for k in range(5) for i in (1, 2)} and [r.seq for r in waiting.collect()] == [3]
    done, waiting = C.run_jobs(jobs.where("seq = 1"), lambda r: r.select("priority", (F.col("seq") + 1).alias("seq")))
    assert done.count() == C.ROUNDS + 1 and waiting.count() == 1


def test_functions_have_policies(spark):
    found = Functions()

    @found.register("half", "int", ("int",), skip_null=False, inverse=lambda y: y * 2)
    def half(x):
        return 10 // x

    rows = spark.createDataFrame([(2,), (0,), (None,)], "x int").select(found["half"](F.col("x")).alias("v"), found["half"].invert(F.col("x")).alias("w"))
    assert [tuple(r) for r in rows.collect()] == [(5, 4), (None, 0), (None, 0)]


def test_patterns(spark):
    p = patterns.compile_pattern("{a=identifier}-[{n=integer}]!(x)")
    assert value(spark, p.matches(F.lit("ab-12yz"))) and not value(spark, p.matches(F.lit("ab-12x")))
    q = patterns.compile_pattern("/p/{id=integer}[/{tab=alphaNumString}]")
    assert value(spark, q.extract(F.lit("/p/5"))) == {"id": "5", "tab": None} and value(spark, q.extract(F.lit("/p/x"))) is None
    assert value(spark, q.build({"id": F.lit(5), "tab": F.lit("t")})) == "/p/5/t" and value(spark, q.build({"tab": F.lit("t")})) is None
    assert value(spark, patterns.compile_pattern("id={n=digits}").replace(F.lit("id=12 id=3"))) == "n n".replace("n", "id=n")
    for text in ("{x", "{a=nothing}", "[a"):
        with pytest.raises(patterns.PatternError):
            patterns.compile_pattern(text)


def test_transactions(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, None, 0)], "id int, name string, version int")
    tx = dml.Transaction({"t": base, "fixed": base}, read_only=["fixed"])
    tx.update("t", spark.createDataFrame([(1, None, 0)], "id int, name string, version int"), ["id"], "version")
    tx.insert("t", spark.createDataFrame([("z", 5), ("y", 5)], "name string, version int"), "id")
    tx.delete("t", base.where("id = 2"), ["id"])
    tx.delete("fixed", base, ["id"])
    assert sorted(map(tuple, tx.read("t").collect())) == [(1, None, 1), (3, None, 0), (4, "y", 5), (5, "z", 5)]
    assert tx.read("fixed").count() == 0
    with pytest.raises(dml.StaleData):
        tx.update("t", spark.createDataFrame([(1, "x", 0)], "id int, name string, version int"), ["id"], "version")
    assert list(tx.commit(spark, f"file://{tmp_path}/out")) == ["t"] and tx.read("t").count() == 4 and not tx.changed()[:0]
    tx.delete("t", tx.read("t"), ["id"])
    tx.rollback()
    assert tx.read("t").count() == 4
    assert dml.cascade_order({"line": ["order"], "order": ["customer"], "customer": []}) == ["customer", "order", "line"]


def test_numbers_follow_the_order_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    got = dml.numbered(rows, ["x"], "n").collect()
    assert sorted((r.n, r.x) for r in got) == [(i + 1, i) for i in range(1000)]


def test_lists(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "p int, pos int, c string, t string")
    old, new = rows((1, 0, "a", "x"), (1, 1, "b", "x"), (1, 2, "d", "x")), rows((1, 0, "a", "y"), (1, 1, "e", "x"), (1, 3, "b", "x"))
    got = {r.c: r.change for r in setops.ordered_changes(old, new, "p", "pos", "c", ["t"]).collect()}
    assert got == {"a": "replace", "b": "move", "d": "remove", "e": "insert"}


def test_delimited_files(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("id|name|day\n#skipped\n" + "".join(f"{i}|{'' if i % 2 else 'n'}|2020-01-01\n" for i in range(1500)) + "9999|last\n")
    got = files.read_delimited(spark, f"file://{path}", "id int, name string, day date", "|", header=True, comment="#", skip=["day"])
    assert got.count() == 1501 and got.where("name IS NULL").count() == 750 and got.columns == ["id", "name"]
    with pytest.raises(ValueError):
        files.DataSource("x", folder=str(tmp_path), read_only=True).write(got, "t")


def test_loops_of_bindings_are_errors():
    assert C.check_acyclic({"a": ["b"], "b": []}) == ["b", "a"]
    with pytest.raises(ValueError):
        C.check_acyclic({"a": ["b"], "b": ["a"]})


@pytest.fixture
def log(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.select(F.col("user_id").alias("obj"), F.col("event_type").alias("prop"), F.col("value").alias("val"), F.col("event_id").alias("seq"))
    for k in range(4):
        rows.where(F.col("seq") % 4 == k).write.parquet(f"{tmp_path}/log/{k}")
    return rows


def test_streams_give_what_batches_give(spark, tmp_path, log):
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/*")
    folder = f"file://{tmp_path}/view"
    stream.maintain(source, stream.view_writer(spark, folder), f"file://{tmp_path}/c1").awaitTermination()
    want = sorted(map(tuple, C.latest(log).collect()))
    assert sorted(map(tuple, stream.view(spark, folder).select("obj", "prop", "val").collect())) == want
    again = log.where("seq % 4 = 3").select("obj", "prop", "val", "seq")
    stream.view_writer(spark, folder)(again, 3)  # a batch that is tried again
    assert sorted(map(tuple, stream.view(spark, folder).select("obj", "prop", "val").collect())) == want
    few = spark.createDataFrame([(1, "p", 2.5, 10**9)], "obj long, prop string, val double, seq long")
    stream.view_writer(spark, folder)(few, 4)
    assert len(list((tmp_path / "view" / "batch=4").glob("bucket=*"))) == 1
    assert stream.view(spark, folder).where("obj = 1 AND prop = 'p'").first()["val"] == 2.5 and stream.view(spark, folder).count() == len(want) + 1
    values = stream.latest_values(source)
    values.writeStream.outputMode("update").format("memory").queryName("latest_values").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    top = spark.table("latest_values").groupBy("obj", "prop").agg(F.max_by("val", "seq").alias("val"))
    assert sorted(map(tuple, top.collect())) == want


def test_lists_are_kept_in_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, "add", "a", 1), (1, "add", "b", 2), (1, "add", "", 5), (1, "add", "c\x1fd, e", 6), (1, "add", None, 7), (2, "add", "x", 3), (2, "remove", "x", 4)], "obj long, op string, item string, seq long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/log/0")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/log/*")
    query = stream.list_events(source).writeStream.outputMode("update").format("memory").queryName("lists").option("checkpointLocation", f"file://{tmp_path}/c")
    query.trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("lists").collect()] == [(1, 5, ["a", "b", "", "c\x1fd, e", None])]
    more = spark.createDataFrame([(1, "remove", "", 8), (1, "remove", "b", 9)], "obj long, op string, item string, seq long")
    more.coalesce(1).write.parquet(f"{tmp_path}/log/1")
    query = stream.list_events(source).writeStream.outputMode("update").format("memory").queryName("lists_2").option("checkpointLocation", f"file://{tmp_path}/c_2")
    query.trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("lists_2").collect()][-1] == (1, 3, ["a", "c\x1fd, e", None])


def test_batches_are_retried_and_dispatched_by_priority(spark):
    seen, tries = [], []

    def flaky(batch, number):
        tries.append(number)
        if len(tries) < 3:
            raise RuntimeError("not yet")

    stream.retried(flaky, poll=0.01)(None, 7)
    assert tries == [7, 7, 7]
    with pytest.raises(RuntimeError):
        stream.retried(lambda b, n: (_ for _ in ()).throw(RuntimeError("never")), poll=0.01, timeout=0.05)(None, 1)
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, None)], "id int, priority int")
    stream.prioritised(lambda events, priority, number: seen.append((priority, sorted(r.id for r in events.collect()), number)))(rows, 2)
    assert seen == [(9, [2], 2), (5, [1, 3], 2), (None, [4], 2)]


def test_streams_join_within_an_interval_and_drop_repeats(spark, tmp_path):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    calls = [(1, at(0)), (2, at(5)), (3, at(6)), (9, at(50))]
    results = [(1, "a", at(3)), (2, "late", at(30)), (9, "z", at(51))]
    spark.createDataFrame(calls, "call int, called_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/calls/0")
    spark.createDataFrame(results, "result_key int, result string, result_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/results/0")
    a = spark.readStream.schema("call int, called_at timestamp").parquet(f"{tmp_path}/calls/*")
    b = spark.readStream.schema("result_key int, result string, result_at timestamp").parquet(f"{tmp_path}/results/*")
    joined = stream.answered(a, b, "call", "10 seconds")
    joined.writeStream.format("memory").queryName("answers").option("checkpointLocation", f"file://{tmp_path}/ck1").trigger(availableNow=True).start().awaitTermination()
    assert {(r.call, r.result) for r in spark.table("answers").collect()} == {(1, "a"), (2, None), (3, None), (9, "z")}
    once = stream.deduped(a.union(a), "called_at", "10 seconds", ["call"])
    once.writeStream.format("memory").queryName("once").option("checkpointLocation", f"file://{tmp_path}/ck2").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.call for r in spark.table("once").collect()) == [1, 2, 3, 9]


def test_cascades_and_atomic_commits(spark, tmp_path):
    customers = spark.createDataFrame([(7, "old")], "id long, name string")
    orders = spark.createDataFrame([(3, 7)], "id long, customer long")
    tx = dml.Transaction({"orders": orders, "customers": customers})
    new_customers = spark.createDataFrame([(-1, "a"), (-2, "b")], "key long, name string")
    new_orders = spark.createDataFrame([(-10, -1), (-11, 7), (-12, None)], "key long, customer long")
    ids = tx.cascade({"orders": dml.New(new_orders, "key", "id", {"customer": "customers"}), "customers": dml.New(new_customers, "key", "id")})
    name_of = {r["_old"]: r["_new"] for r in ids["customers"].collect()}
    assert sorted(name_of.values()) == [8, 9]
    assert sorted((r.id, r.name) for r in tx.read("customers").collect()) == sorted([(7, "old"), (name_of[-1], "a"), (name_of[-2], "b")])
    assert sorted((r.customer or 0) for r in tx.read("orders").collect()) == sorted([0, 7, 7, name_of[-1]]) and {r.id for r in tx.read("orders").collect()} == {3, 4, 5, 6}
    folder = f"file://{tmp_path}/db"
    assert dml.current_tables(spark, folder) == {}
    tx.commit(spark, folder)
    assert {n: t.count() for n, t in dml.current_tables(spark, folder).items()} == {"customers": 3, "orders": 4}
    tx.delete("customers", tx.read("customers").where("id = 7"), ["id"])
    tx.insert("orders", tx.read("orders").withColumn("id", F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        tx.commit(spark, folder)
    assert {n: t.count() for n, t in dml.current_tables(spark, folder).items()} == {"customers": 3, "orders": 4}


def test_bindings_go_both_ways_and_references_move(spark):
    rows = spark.createDataFrame([(1.0, 0.0, "l"), (0.0, 8.0, "r"), (5.0, 6.0, None)], "l double, r double, changed string")
    got = C.bound(rows, "l", "r", F.col("r") / 2, F.col("l") * 2, "changed")
    assert [(x.l, x.r) for x in got.collect()] == [(1.0, 2.0), (4.0, 8.0), (5.0, 6.0)]
    moved = spark.createDataFrame([(1, 10, 20), (2, None, 20), (3, 10, None), (4, 10, 10)], "id int, was int, now int")
    got = sorted(map(tuple, C.reverse_changes(moved, "id", "was", "now").collect()))
    assert got == [(10, 1, "removed"), (10, 3, "removed"), (20, 1, "added"), (20, 2, "added")]


def test_commands_of_all_kinds_are_read_back(spark):
    rows = [
        (1, 1, "state", None, None, "init", None, None, None), (1, 2, "new", "p", "o1", "T", None, '[1, "x"]', None), (1, 3, "prop", "p", 'o"1', "a", '{"k":[1,2]}', None, None),
        (1, 4, "method", "q", "o1", "m", None, "[2]", "c1"), (1, 5, "result", "q", None, "int", "7", None, "c1"), (1, 6, "fetch", "q", "o1", "b", None, None, None),
        (1, 7, "rename", "q", "o1", "o2", None, None, None), (1, 8, "renameAck", "q", "o1", "o2", None, None, None), (1, 9, "clearReset", "q", "o2", None, None, None, None), (2, 1, "prop", "p", "z", "a", "null", None, None),
    ]
    changes = spark.createDataFrame(rows, "scope int, seq int, kind string, pkg string, obj string, name string, val string, args string, call_id string")
    docs = C.wire(changes)
    shown = {r.scope: r.doc for r in docs.collect()}
    import json

    assert json.loads(shown[1])["sync"][:4] == [{"$pkg": ""}, {"$syncState": "init"}, {"$pkg": "p"}, {"$new": ["o1", "T", [1, "x"]]}]
    got = [tuple(r) for r in C.unwired(docs).orderBy("scope", "at").select("scope", "kind", "pkg", "obj", "name", "val", "args", "call_id").collect()]
    want = [(s, k, p or "", o, n, v, a and a.replace(", ", ","), c) for s, _, k, p, o, n, v, a, c in rows]
    assert [(x[:6] + (x[6] and x[6].replace(", ", ","), x[7])) for x in got] == [w if w[0] == 1 else (2, "prop", "p", "z", "a", None, None, None) for w in want]
    assert C.unwired(spark.createDataFrame([(1, "no json")], "scope int, doc string")).collect() == []


def test_markup_and_typed_json(spark):
    xml = '<order id="5"><name>n</name><line>a</line><line>b</line></order>'
    got = value(spark, files.parse_xml(F.lit(xml), "_id int, name string, line array<string>"))
    assert (got["_id"], got["name"], got["line"]) == (5, "n", ["a", "b"])
    css = "/* x { } */ a , b.c { color : red; background: url(http://x/y); color: blue }\n@media print { p { margin:0 } } q{}"
    rules = [(r["selector"], r["declarations"]) for r in value(spark, files.css_rules(F.lit(css)))]
    assert rules[0] == ("a , b.c", {"background": "url(http://x/y)", "color": "blue"}) and rules[1][1] == {"margin": "0"} and rules[2] == ("q", {})
    text = "# Title\n\none\ntwo\n\n- item\n2. next\n> said\n```py\ncode # x\n\nmore\n```\n### Last"
    blocks = [tuple(b) for b in value(spark, files.markdown_blocks(F.lit(text)))]
    assert blocks == [("heading", 1, "Title"), ("paragraph", 0, "one two"), ("item", 0, "item"), ("item", 0, "next"), ("quote", 0, "said"), ("code", 0, "code # x\n\nmore"), ("heading", 3, "Last")]
    docs = ['{"class":"Cat","lives":9}', '{"class":"Dog","name":"r"}', '{"class":"Eel"}', "no"]
    rows = spark.createDataFrame([(d,) for d in docs], "doc string").select(files.typed_json(F.col("doc"), {"Cat": "lives int", "Dog": "name string"}).alias("v")).collect()
    assert [(r.v["class"], r.v["Cat"] and r.v["Cat"]["lives"], r.v["Dog"] and r.v["Dog"]["name"]) for r in rows] == [("Cat", 9, None), ("Dog", None, "r"), ("Eel", None, None), (None, None, None)]
    assert value(spark, files.json_enum(F.lit("B"), ["A", "B"])) == "B" and value(spark, files.json_enum(F.lit("C"), ["A", "B"])) is None
    assert value(spark, files.json_text(F.lit("\\ref:x"))) == "ref:x" and value(spark, files.json_text(F.lit("a"))) == "a"


def test_jdbc_sources(spark):
    url = "jdbc:derby:memory:tessera;create=true"
    source = files.DataSource("db", jdbc={"url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    rows = spark.createDataFrame([(1, 2.5), (2, None)], "id int, x double")
    source.write(rows, "readings")
    source.write(rows.where("id = 1"), "readings")
    assert source.table(spark, "readings").where("ID = 1").count() == 2 and source.table(spark, "readings").count() == 3
    with pytest.raises(ValueError):
        files.DataSource("off", jdbc={"url": url}, disabled=True).table(spark, "readings")


def test_timers(spark):
    from tessera.operators import stats

    timers, off = stats.Timers(), stats.Timers(enabled=False)
    for _ in range(3):
        with timers.measured("a"), off.measured("a"):
            pass
    (row,) = timers.stats(spark).collect()
    assert (row["name"], row["n"]) == ("a", 3) and 0 <= row["low"] <= row["high"] <= row["total"] and off.stats(spark).count() == 0


def test_what_is_recorded_and_counted(spark):
    log = spark.createDataFrame([(1, "T", "RecordingChanges"), (1, "T", "ApplyingChanges"), (2, "U", "Disabled")], "obj long, type string, state string")
    assert C.recorded(log).count() == 1
    assert sorted(map(tuple, C.type_counts(log).collect())) == [("T", 1), ("U", 1)]


def test_tokens_differ():
    from tessera.functions import tokens

    assert tokens.unique_token() != tokens.unique_token() and len(tokens.salt_bytes(tokens.salt())) == 16
