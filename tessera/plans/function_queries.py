"""The registered queries for files, functions, patterns and change logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import patterns
from tessera.functions import scalar as S
from tessera.functions.registry import UserFunction
from tessera.operators import changes as C
from tessera.operators import dml, joins
from tessera.plans import ddl
from tessera.plans.retail_queries import over_tables
from tessera.sources import files

# Files


@over_tables(
    "csv_parse_rows",
    "SELECT c_custkey AS id, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, '') AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer WHERE c_custkey % 5 <> 0",
    "customer",
)
def _(customer):
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_name"))
    nation = F.when(F.col("c_custkey") % 4 == 0, F.lit("x")).otherwise(F.col("c_nationkey").cast("string"))
    mark = F.when(F.col("c_custkey") % 5 == 0, F.lit("#")).otherwise(F.lit(""))
    lines = customer.select(F.concat(mark, F.concat_ws(",", F.col("c_custkey").cast("string"), name, nation)).alias("line"))
    return files.parse_delimited(lines, "line", {"id": "bigint", "name": "string", "nation": "int"}, comment="#")


@over_tables("csv_roundtrip", "SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS p_size, p_retailprice FROM part", "part")
def _(part):
    rows = part.select("p_partkey", "p_name", F.when(F.col("p_size") <= 25, F.col("p_size")).alias("p_size"), "p_retailprice")
    lines = files.to_delimited(rows, "|")
    return files.parse_delimited(lines, "line", {"p_partkey": "bigint", "p_name": "string", "p_size": "int", "p_retailprice": "double"}, separator="|")


_DOC = """to_json(named_struct('a', named_struct('b', o_custkey), 'd', '2020-01-02', 'ok', o_orderstatus = 'F', 'x', o_totalprice, 'l', array(o_orderkey, 1), 'r', concat('ref:db:', o_custkey)))"""


@over_tables(
    "json_parse_typed",
    "SELECT o_orderkey, o_custkey AS b, DATE '2020-01-02' AS d, o_orderstatus = 'F' AS ok, o_totalprice AS x, o_orderkey AS first, o_custkey AS ref FROM orders",
    "orders",
)
def _(orders):
    docs = orders.select("o_orderkey", F.expr(_DOC).alias("doc"))
    v = files.parse_json(F.col("doc"), "a struct<b: bigint>, d date, ok boolean, x double, l array<bigint>, r string")
    rows = docs.select("o_orderkey", v.alias("v"))
    return rows.select("o_orderkey", "v.a.b", "v.d", "v.ok", "v.x", S.element(F.col("v.l"), 0).alias("first"), files.json_reference(F.col("v.r")).alias("ref"))


@over_tables(
    "json_serialize",
    """SELECT c_custkey, '{"name":"' || c_name || '"' || CASE WHEN c_nationkey < 10 THEN ',"nation":' || c_nationkey ELSE '' END || ',"ref":"ref:db:' || c_nationkey || '"}' AS doc FROM customer""",
    "customer",
)
def _(customer):
    nation = F.when(F.col("c_nationkey") < 10, F.col("c_nationkey"))
    ref = F.concat(F.lit("ref:db:"), F.col("c_nationkey").cast("string"))
    return customer.select("c_custkey", files.to_json(F.struct(F.col("c_name").alias("name"), nation.alias("nation"), ref.alias("ref"))).alias("doc"))


@over_tables("html_tag_extract", "SELECT page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title FROM pages", "pages")
def _(pages):
    return pages.select("page_id", files.tag_text(F.col("html"), "title").alias("title"))


# Arithmetic

_WRAP = "CAST(((({} + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648 AS INTEGER)"


@over_tables(
    "int_arith",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, {_WRAP.format("(CAST(l_partkey AS BIGINT) * 1000003)")} AS times,
        {_WRAP.format("(2147483647::BIGINT + l_linenumber)")} AS plus, CAST(-l_partkey // (l_linenumber + 1) AS BIGINT) AS quotient, CAST(-l_partkey % (l_linenumber + 1) AS BIGINT) AS rest,
        CAST(l_linenumber & 6 AS INTEGER) AS both, CAST(l_linenumber | 8 AS INTEGER) AS either, CAST(xor(l_linenumber, 5) AS INTEGER) AS differs, CAST(l_partkey << 3 AS BIGINT) AS lefts, CAST(l_partkey >> 2 AS BIGINT) AS rights,
        CAST((4294967296 - l_linenumber) // 4 AS INTEGER) AS unsigned, CAST(NULL AS INTEGER) AS by_zero FROM lineitem""",
    "lineitem",
)
def _(lineitem):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    return lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        S.int_op("*", p, 1_000_003).alias("times"),
        S.int_op("+", 2**31 - 1, n).alias("plus"),
        S.int_op("/", -p, n + 1, 64).alias("quotient"),
        S.int_op("%", -p, n + 1, 64).alias("rest"),
        S.int_op("&", n, 6).alias("both"),
        S.int_op("|", n, 8).alias("either"),
        S.int_op("^", n, 5).alias("differs"),
        S.int_op("<<", p, 3, 64).alias("lefts"),
        S.int_op(">>", p, 2, 64).alias("rights"),
        S.int_op(">>>", -n, 2).alias("unsigned"),
        S.int_op("/", n, 0).alias("by_zero"),
    )


@over_tables(
    "float_arith",
    """SELECT o_orderkey, round(o_totalprice + 0.5, 6) AS plus, round(o_totalprice - 1e3, 6) AS minus, round(o_totalprice * 1.5, 6) AS times, round(o_totalprice / 7.0, 6) AS quotient,
       round(o_totalprice % 100.0, 4) AS rest, CASE o_orderkey % 3 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' ELSE '-Infinity' END AS by_zero,
       CASE o_orderkey % 3 WHEN 0 THEN 'NaN' WHEN 1 THEN '-Infinity' ELSE 'Infinity' END AS by_minus_zero, 'NaN' AS rest_by_zero FROM orders""",
    "orders",
)
def _(orders):
    x = F.col("o_totalprice")
    r = lambda c, n=6: F.round(c, n)
    signed = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).when(F.col("o_orderkey") % 3 == 1, F.lit(2.5)).otherwise(F.lit(-2.5))
    return orders.select(
        "o_orderkey",
        r(S.float_op("+", x, 0.5)).alias("plus"),
        r(S.float_op("-", x, 1e3)).alias("minus"),
        r(S.float_op("*", x, 1.5)).alias("times"),
        r(S.float_op("/", x, 7.0)).alias("quotient"),
        r(S.float_op("%", x, 100.0), 4).alias("rest"),
        S.float_op("/", signed, 0.0).cast("string").alias("by_zero"),
        S.float_op("/", signed, F.lit(0.0) * F.lit(-1.0)).cast("string").alias("by_minus_zero"),
        S.float_op("%", signed, 0.0).cast("string").alias("rest_by_zero"),
    )


@over_tables(
    "mixed_promotion",
    "SELECT p_partkey, CAST(p_size + p_partkey AS BIGINT) AS whole, round(p_size + p_retailprice, 6) AS fraction, p_name || '-' || CAST(p_size AS VARCHAR) AS text FROM part",
    "part",
)
def _(part):
    size = F.col("p_size")
    return part.select(
        "p_partkey",
        S.mixed_op("+", size, "int", F.col("p_partkey"), "bigint").alias("whole"),
        F.round(S.mixed_op("+", size, "int", F.col("p_retailprice"), "double"), 6).alias("fraction"),
        S.mixed_op("+", F.concat("p_name", F.lit("-")), "string", size, "int").alias("text"),
    )


@over_tables("unary_ops", "SELECT p_partkey, p_size AS plus, -p_size AS minus, ~p_size AS inverted, p_size + 1 AS up, p_size - 1 AS down, NOT (p_size > 10) AS negated FROM part", "part")
def _(part):
    n = F.col("p_size")
    named = {"plus": "+", "minus": "-", "inverted": "~", "up": "++", "down": "--"}
    return part.select("p_partkey", *[S.unary_op(op, n).alias(k) for k, op in named.items()], S.unary_op("!", n > 10).alias("negated"))


@over_tables(
    "inverse_ops",
    """SELECT p_partkey, round((p_size * 3.0) / 3.0, 6) AS times_left, round(p_retailprice - 10.0, 6) AS plus_left, round(10.0 - p_retailprice, 6) AS minus_right, round(p_retailprice * 4.0, 6) AS over_left,
       round(100.0 / p_retailprice, 6) AS over_right, -p_size AS negated FROM part""",
    "part",
)
def _(part):
    x = F.col("p_retailprice")
    r = lambda c: F.round(c, 6)
    return part.select(
        "p_partkey",
        r(S.inverse_op("*", F.col("p_size") * 3.0, F.lit(3.0))).alias("times_left"),
        r(S.inverse_op("+", x, F.lit(10.0))).alias("plus_left"),
        r(S.inverse_op("-", x, F.lit(10.0), of_left=False)).alias("minus_right"),
        r(S.inverse_op("/", x, F.lit(4.0))).alias("over_left"),
        r(S.inverse_op("/", x, F.lit(100.0), of_left=False)).alias("over_right"),
        S.inverse_unary("-", F.col("p_size")).alias("negated"),
    )


@over_tables(
    "ternary",
    "SELECT doc_id, CASE WHEN quality = 1 THEN 'good' WHEN quality <> 1 THEN 'bad' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)",
    "documents",
    "labels",
)
def _(documents, labels):
    return documents.join(labels, "doc_id", "left").select("doc_id", S.ternary(F.col("quality") == 1, "good", "bad").alias("verdict"))


@over_tables(
    "cast_types",
    f"""SELECT o_orderkey, {_WRAP.format("(o_orderkey * 3000000007)")} AS low_bits, CAST(trunc(o_totalprice) AS INTEGER) AS whole, CAST(2147483647 AS INTEGER) AS bounded,
        CAST(((o_orderkey + 128) % 256) - 128 AS TINYINT) AS byte, CAST(o_orderkey AS VARCHAR) AS text FROM orders""",
    "orders",
)
def _(orders):
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    return orders.select(
        "o_orderkey",
        S.narrowed(k * F.lit(3_000_000_007)).alias("low_bits"),
        S.bounded(x).alias("whole"),
        S.bounded(x + F.lit(1e300)).alias("bounded"),
        S.java_cast(k, "tinyint").alias("byte"),
        S.java_cast(k, "string").alias("text"),
    )


@over_tables("default_values", "SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(quality = 1, false) AS good, lang FROM documents LEFT JOIN labels USING (doc_id)", "documents", "labels")
def _(documents, labels):
    rows = documents.join(labels, "doc_id", "left")
    return rows.select("doc_id", S.with_default(F.col("quality"), "int").alias("quality"), S.with_default(F.col("quality") == 1, "boolean").alias("good"), S.with_default(F.col("lang"), "string").alias("lang"))


# Arrays


@over_tables("array_element", "SELECT vec_id, embedding[1] AS first, embedding[64] AS last, CAST(NULL AS FLOAT) AS beyond FROM embeddings", "embeddings")
def _(embeddings):
    e = F.col("embedding")
    return embeddings.select("vec_id", S.element(e, 0).alias("first"), S.element(e, 63).alias("last"), S.element(e, 64).alias("beyond"))


@over_tables(
    "array_set",
    "SELECT c_custkey, CAST(c_custkey AS VARCHAR) || ',7,' || CAST(c_nationkey AS VARCHAR) AS items FROM customer",
    "customer",
)
def _(customer):
    items = F.array(F.col("c_custkey"), F.lit(1).cast("bigint"), F.col("c_nationkey").cast("bigint"))
    changed = S.with_element(items, 1, F.lit(7).cast("bigint"))
    return customer.select("c_custkey", F.array_join(F.transform(changed, lambda x: x.cast("string")), ",").alias("items"))


@over_tables("array_build", "SELECT c_custkey, c_name || '|' || c_mktsegment AS pair, CAST(2 AS INTEGER) AS n, c_name AS boxed FROM customer", "customer")
def _(customer):
    pair = F.array("c_name", "c_mktsegment")
    return customer.select("c_custkey", S.joined(pair, "|").alias("pair"), S.array_length(pair).alias("n"), F.struct(F.col("c_name").alias("x")).getField("x").alias("boxed"))


@over_tables("array_slice", "SELECT vec_id, CAST(len(embedding[3:10]) AS INTEGER) AS n, embedding[3] AS first, embedding[3:10] = embedding[3:10] AS same FROM embeddings", "embeddings")
def _(embeddings):
    part = S.array_range(F.col("embedding"), 2, 10)
    return embeddings.select("vec_id", F.size(part).alias("n"), S.element(part, 0).alias("first"), (part == part).alias("same"))


# Strings


@over_tables(
    "string_concat_skipnull",
    "SELECT doc_id, lang || coalesce('/' || quality, '') AS bound, lang || '/' || coalesce(CAST(quality AS VARCHAR), 'null') AS raw FROM documents LEFT JOIN labels USING (doc_id)",
    "documents",
    "labels",
)
def _(documents, labels):
    rows = documents.join(labels, "doc_id", "left")
    slash = F.when(F.col("quality").isNotNull(), F.lit("/"))
    return rows.select("doc_id", S.concat_set(F.col("lang"), slash, F.col("quality")).alias("bound"), S.concat_raw(F.col("lang"), F.lit("/"), F.col("quality")).alias("raw"))


@over_tables(
    "string_tests",
    """SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 3 = 1 AS empty, true AS blank, c_custkey % 3 < 2 AS same FROM customer""",
    "customer",
)
def _(customer):
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 3 == 2, F.lit(" \t"))
    return customer.select("c_custkey", S.is_empty(text).alias("empty"), S.is_blank(text).alias("blank"), S.equal_strings(text, F.lit(None).cast("string")).alias("same"))


@over_tables("string_split", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS first, CAST(len(string_split(o_orderpriority, '-')) AS INTEGER) AS n, 'two words' AS quoted FROM orders", "orders")
def _(orders):
    parts = S.split_plain(F.col("o_orderpriority"), "-")
    quoted = S.split_quoted(F.concat(F.col("o_orderpriority"), F.lit(' "two words" end')))
    return orders.select("o_orderkey", S.element(parts, 0).alias("first"), F.size(parts).alias("n"), F.element_at(quoted, -2).alias("quoted"))


@over_tables("string_repeat_join", "SELECT n_nationkey, repeat('   ', n_regionkey) || n_name AS indented, n_name || ', ' || n_name AS joined FROM nation", "nation")
def _(nation):
    return nation.select("n_nationkey", F.concat(S.indent(F.col("n_regionkey")), "n_name").alias("indented"), S.joined(F.array("n_name", "n_name")).alias("joined"))


@over_tables(
    "escape_html",
    """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, replace(url, '''', '&apos;') AS quoted FROM pages""",
    "pages",
)
def _(pages):
    return pages.select("page_id", S.escape_html(F.col("html")).alias("escaped"), S.escape_quotes(F.col("url"), single=True).alias("quoted"))


@over_tables(
    "ellipsis",
    """SELECT item_id, CASE WHEN length(text) <= 20 THEN text ELSE left(text, 17) || '...' END AS cut,
       CASE WHEN length(text) <= 20 THEN text WHEN instr(left(text, 18), ' ') = 0 THEN left(text, 17) || '...'
            ELSE left(text, 18 - instr(reverse(left(text, 18)), ' ')) || '...' END AS by_words FROM benchmark""",
    "benchmark",
)
def _(benchmark):
    text = F.col("text")
    return benchmark.select("item_id", S.ellipsis(text, 20).alias("cut"), S.ellipsis(text, 20, whole_words=True).alias("by_words"))


@over_tables(
    "name_case",
    """SELECT * FROM (VALUES ('o_order_key', 'order_key_id', 'OOrderKey'), ('name', 'x', 'Name'), ('c_mktsegment', 'a_b', 'CMktsegment')) t(sql_name, other, java_name)""",
    "nation",
)
def _(nation):
    rows = nation.sparkSession.createDataFrame([("o_order_key", "orderKeyId"), ("name", "X"), ("c_mktsegment", "aB")], "sql_name string, camel string")
    return rows.select("sql_name", S.snake_case(F.col("camel")).alias("other"), S.camel_case(F.col("sql_name")).alias("java_name"))


_SHOWN = r"regexp_replace(regexp_replace(printf('%.2f', {}), '(\.[0-9]*?)0+$', '\1'), '\.$', '')"


@over_tables(
    "format_float",
    f"""SELECT o_orderkey, {_SHOWN.format("o_totalprice / 4")} AS shown, {_SHOWN.format("(o_orderkey % 4000 - 2000) / 8.0::DOUBLE")} AS tie,
        {_SHOWN.format("(o_orderkey % 2000) / 1000.0::DOUBLE + 0.005::DOUBLE")} AS near, CASE o_orderkey % 3 WHEN 0 THEN 'NaN' WHEN 1 THEN '∞' ELSE '-∞' END AS special FROM orders""",
    "orders",
)
def _(orders):
    k = F.col("o_orderkey")
    special = S.float_op("/", F.when(k % 3 == 0, F.lit(0.0)).when(k % 3 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)), 0.0)
    return orders.select(
        "o_orderkey",
        S.format_float(F.col("o_totalprice") / 4).alias("shown"),
        S.format_float((k % 4000 - 2000) / F.lit(8.0)).alias("tie"),
        S.format_float((k % 2000) / F.lit(1000.0) + F.lit(0.005)).alias("near"),
        S.format_float(special).alias("special"),
    )


@over_tables("hash_sha", "SELECT c_custkey, sha1(c_name) AS sha1, sha256(c_name) AS sha256 FROM customer", "customer")
def _(customer):
    return customer.select("c_custkey", S.sha1_hex(F.col("c_name")).alias("sha1"), F.sha2("c_name", 256).alias("sha256"))


@over_tables(
    "url_parts",
    """SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, split_part(url, '/', 1) AS root, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS file, false AS relative,
       regexp_replace(replace(regexp_replace('a b!' || regexp_extract(url, '[^/]*$'), '\\.\\.+', '.', 'g'), ' ', '_'), '[^A-Za-z0-9._/-]', '', 'g') AS clean FROM pages""",
    "pages",
)
def _(pages):
    url = F.col("url")
    return pages.select(
        "page_id",
        S.parent_path(url).alias("parent"),
        S.root_path(url).alias("root"),
        S.file_name(url).alias("file"),
        S.is_relative_url(url).alias("relative"),
        S.clean_file_name(F.concat(F.lit("a b!"), F.regexp_extract(url, "[^/]*$", 0))).alias("clean"),
    )


@over_tables("enum_ordinal", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 END AS ordinal, o_orderstatus AS name FROM orders", "orders")
def _(orders):
    names = ["O", "F", "P"]
    ordinal = S.enum_ordinal(F.col("o_orderstatus"), names)
    return orders.select("o_orderkey", ordinal.alias("ordinal"), S.enum_name(ordinal, names).alias("name"))


@over_tables("date_parse_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS day FROM orders", "orders")
def _(orders):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select("o_orderkey", S.format_date(S.parse_date(iso)).alias("iso"), S.format_date(S.parse_date(day)).alias("day"))


@over_tables(
    "date_token",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '<recent-date>' WHEN event_id % 3 = 1 THEN '<month-from-now-date>' ELSE '2024-01-31T10:00:00Z' END AS shown FROM events""",
    "events",
)
def _(events):
    now = F.to_timestamp(F.lit("2024-03-01 12:00:00"))
    ago = F.when(F.col("event_id") % 3 == 0, F.expr("INTERVAL '30' MINUTE")).when(F.col("event_id") % 3 == 1, F.expr("INTERVAL '-2592010' SECOND")).otherwise(F.expr("INTERVAL '30 02:00:00' DAY TO SECOND"))
    return events.select("event_id", S.date_token(now - ago, now).alias("shown"))


# Patterns

_URL = patterns.compile_pattern("{proto=identifier}://{host=urlString}/{lang=identifier}/{id=integer}[?{q=escapedString}]")
_RE = r"^([A-Za-z_$][A-Za-z0-9_$]*)://([A-Za-z0-9$_.+!*''(),-]+)/([A-Za-z_$][A-Za-z0-9_$]*)/([0-9]+)(?:\?([^\x22\n]+))?$"


@over_tables("pattern_match", f"SELECT page_id, regexp_matches(url, '{_RE}') AS hit FROM pages", "pages")
def _(pages):
    return pages.select("page_id", _URL.matches(F.col("url")).alias("hit"))


@over_tables(
    "pattern_extract",
    f"""SELECT page_id, regexp_extract(url, '{_RE}', 2) AS host, CAST(regexp_extract(url, '{_RE}', 4) AS INTEGER) AS id, nullif(regexp_extract(url, '{_RE}', 5), '') AS q FROM pages WHERE regexp_matches(url, '{_RE}')""",
    "pages",
)
def _(pages):
    rows = pages.where(_URL.matches(F.col("url"))).select("page_id", _URL.extract(F.col("url")).alias("v"))
    return rows.select("page_id", F.col("v.host"), F.col("v.id").cast("int").alias("id"), F.col("v.q"))


@over_tables("pattern_replace", "SELECT page_id, regexp_replace(url, '/([A-Za-z_$][A-Za-z0-9_$]*)/([0-9]+)', '/lang/id', 'g') AS shown FROM pages", "pages")
def _(pages):
    return pages.select("page_id", patterns.compile_pattern("/{lang=identifier}/{id=integer}").replace(F.col("url")).alias("shown"))


@over_tables(
    "pattern_build",
    """SELECT d.doc_id, CASE WHEN lang <> 'fr' THEN 'docs/' || lang || '/' || d.doc_id || coalesce('?quality=' || quality, '') END AS url FROM documents d LEFT JOIN labels USING (doc_id)""",
    "documents",
    "labels",
)
def _(documents, labels):
    pattern = patterns.compile_pattern("docs/{lang=identifier}/{id=integer}[?quality={quality=integer}]")
    rows = documents.join(labels, "doc_id", "left")
    lang = F.when(F.col("lang") != "fr", F.col("lang"))
    return rows.select("doc_id", pattern.build({"lang": lang, "id": F.col("doc_id"), "quality": F.col("quality")}).alias("url"))


@over_tables(
    "user_agent_parse",
    """SELECT page_id, 'Mozilla' AS name, '5.0' AS version, 'X11; Linux x86_64' AS comment, 'Gecko' AS last_name, '20100101.' || page_id AS last_version FROM pages""",
    "pages",
)
def _(pages):
    agent = F.concat(F.lit("Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101."), F.col("page_id").cast("string"))
    rows = pages.select("page_id", patterns.user_agent(agent).alias("a"))
    first, last = F.element_at("a", 1), F.element_at("a", -1)
    return rows.select("page_id", first["name"].alias("name"), first["version"].alias("version"), first["comment"].alias("comment"), last["name"].alias("last_name"), last["version"].alias("last_version"))


@over_tables("user_function", "SELECT p_partkey, p_size * 2 + 1 AS doubled, p_size AS back FROM part", "part")
def _(part):
    double = UserFunction(lambda x: x * 2 + 1, "int", ("int",), inverse=lambda y: (y - 1) // 2)
    made = double(F.col("p_size"))
    return part.select("p_partkey", made.alias("doubled"), double.invert(made).alias("back"))


# Change logs

_LOG = "l AS (SELECT user_id AS obj, event_type AS prop, value AS val, row_number() OVER (ORDER BY ts, event_id) AS seq, event_id FROM events)"


def _log(events):
    return C.change_log(events, "user_id", "event_type", "value", ["ts", "event_id"])


@over_tables("change_log", "SELECT user_id AS obj, event_type AS prop, value AS val, event_id FROM events", "events")
def _(events):
    return _log(events).select("obj", "prop", "val", F.col("seq.event_id"))


@over_tables("event_dedupe", f"WITH {_LOG} SELECT obj, prop, arg_min(val, seq) AS val, arg_min(event_id, seq) AS event_id FROM l GROUP BY obj, prop", "events")
def _(events):
    return C.deduped(_log(events)).select("obj", "prop", "val", F.col("seq.event_id"))


_PRIORITY = "CASE event_type WHEN 'error' THEN 10 WHEN 'purchase' THEN 5 ELSE 0 END"


@over_tables("event_priority_order", f"SELECT event_id, {_PRIORITY} AS priority, row_number() OVER (ORDER BY {_PRIORITY} DESC, ts, event_id) AS place FROM events", "events")
def _(events):
    rows = events.select("event_id", F.expr(_PRIORITY).alias("priority"), F.struct("ts", "event_id").alias("seq"))
    return C.dispatch_order(rows, "priority").select("event_id", "priority", "place")


@over_tables(
    "same_value_suppress",
    """SELECT user_id AS obj, event_id FROM (SELECT user_id, event_id, floor(value / 50) AS v, lag(floor(value / 50)) OVER w AS before, row_number() OVER w AS n FROM events
       WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE n = 1 OR v IS DISTINCT FROM before""",
    "events",
)
def _(events):
    coarse = events.withColumn("value", F.floor(F.col("value") / 50))
    return C.without_same_values(_log(coarse)).select("obj", F.col("seq.event_id"))


@over_tables(
    "job_order",
    f"SELECT event_id, {_PRIORITY} AS priority, row_number() OVER (ORDER BY {_PRIORITY} DESC, ts, event_id) AS place FROM events WHERE {_PRIORITY} >= 5 AND {_PRIORITY} < 10",
    "events",
)
def _(events):
    rows = events.select("event_id", F.expr(_PRIORITY).alias("priority"), F.struct("ts", "event_id").alias("seq"))
    return C.dispatch_order(C.jobs_between(rows, 5, 10), "priority").select("event_id", "priority", "place")


@over_tables(
    "cross_scope_route",
    """SELECT event_id, s.scope FROM events e JOIN (SELECT 'a' AS scope, c_custkey AS obj FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'b', c_custkey FROM customer WHERE c_custkey % 3 = 0) s ON s.obj = e.user_id
       WHERE s.scope <> CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END""",
    "events",
    "customer",
)
def _(events, customer):
    log = events.select("event_id", F.col("user_id").alias("obj"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("origin"))
    part = lambda scope, n: customer.where(F.col("c_custkey") % n == 0).select(F.lit(scope).alias("scope"), F.col("c_custkey").alias("obj"))
    return C.routed(log, part("a", 2).union(part("b", 3))).select("event_id", "scope")


@over_tables("sync_latest", f"WITH {_LOG} SELECT obj, prop, arg_max(val, seq) AS val FROM l GROUP BY obj, prop", "events")
def _(events):
    return C.latest(_log(events))


@over_tables("sync_overridden", f"WITH {_LOG} SELECT event_id, row_number() OVER (PARTITION BY obj, prop ORDER BY seq DESC) > 1 AS overridden FROM l", "events")
def _(events):
    return C.overridden(_log(events)).select(F.col("seq.event_id"), "overridden")


@over_tables("sync_net_change", f"WITH {_LOG} SELECT obj, prop, arg_min(val, seq) AS first_val, arg_max(val, seq) AS last_val FROM l GROUP BY obj, prop HAVING arg_min(val, seq) IS DISTINCT FROM arg_max(val, seq)", "events")
def _(events):
    return C.net_changes(_log(events))


_KINDS = "['prop', 'new', 'method', 'fetch', 'result', 'rename', 'renameAck', 'clearReset']"


@over_tables("sync_kinds", f"SELECT {_KINDS}[event_id % 8 + 1] AS kind, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1", "events")
def _(events):
    kinds = F.array(*[F.lit(k.strip().strip("'")) for k in _KINDS.strip("[]").split(",")])
    kind = F.get(kinds, (F.col("event_id") % 8).cast("int"))
    return events.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


_OPTIONS = "(VALUES ('view', 1, NULL), ('click', 1, 50.0), ('error', 3, NULL), ('signup', 4, 10.0), ('purchase', 257, NULL))"


@over_tables(
    "sync_initial",
    f"""WITH {_LOG}, v AS (SELECT obj, prop, arg_max(val, seq) AS val FROM l GROUP BY obj, prop), o(prop, flags, def) AS (SELECT * FROM {_OPTIONS})
        SELECT obj, prop, val FROM v JOIN o USING (prop) WHERE CASE WHEN def IS NOT NULL THEN val IS DISTINCT FROM def ELSE flags & 1 <> 0 AND val IS NOT NULL END""",
    "events",
)
def _(events):
    rows = [("view", 1, None), ("click", 1, 50.0), ("error", 3, None), ("signup", 4, 10.0), ("purchase", 257, None)]
    options = events.sparkSession.createDataFrame(rows, "prop string, flags int, default double")
    return C.initial_values(C.latest(_log(events)), F.broadcast(options))


@over_tables("sync_prop_flags", "SELECT event_id, event_id % 512 & 50 = 0 AS by_server, event_id % 512 & 50 = 0 AND event_id % 512 & 256 = 0 AS by_client FROM events", "events")
def _(events):
    flags = F.col("event_id") % 512
    return events.select("event_id", C.sent(flags, True).alias("by_server"), C.sent(flags, False).alias("by_client"))


@over_tables(
    "sync_direction",
    "SELECT event_id, event_id % 6 IN (0, 4) OR (event_id % 6 = 2 AND event_id % 4 < 2) AS to_client, event_id % 6 IN (0, 3) OR (event_id % 6 = 2 AND event_id % 4 < 2) AS to_server FROM events",
    "events",
)
def _(events):
    mode = F.get(F.array(*[F.lit(m) for m in C.MODES]), (F.col("event_id") % 6).cast("int"))
    shared = F.col("event_id") % 4 < 2
    return events.select("event_id", C.crosses(mode, True, shared).alias("to_client"), C.crosses(mode, False, shared).alias("to_server"))


@over_tables("sync_type_filter", "SELECT event_id FROM events WHERE event_type IN ('view', 'error')", "events")
def _(events):
    types = events.sparkSession.createDataFrame([("view",), ("error",)], "event_type string")
    return C.of_types(events, F.broadcast(types), "event_type").select("event_id")


_KIND = "CASE event_type WHEN 'signup' THEN 'new' WHEN 'error' THEN 'method' WHEN 'purchase' THEN 'fetch' ELSE 'prop' END"
_WIRE = """SELECT user_id AS scope, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS pkg, 'u' || user_id AS obj, {kind} AS kind, event_type AS name,
           CAST(CAST(floor(value) AS BIGINT) AS {text}) AS val, '[' || event_id || ']' AS args, 'c' || event_id AS call_id FROM {events}"""


@over_tables(
    "sync_json_encode",
    f"""WITH l AS ({_WIRE.format(kind=_KIND, text="VARCHAR", events="events")}),
        e AS (SELECT *, CASE kind WHEN 'new' THEN '{{"$new":["' || obj || '","' || name || '",' || args || ']}}' WHEN 'method' THEN '{{"' || obj || '":{{"$meth":"' || name || '","callId":"' || call_id || '","args":' || args || '}}}}'
              WHEN 'fetch' THEN '{{"' || obj || '":{{"$get":"' || name || '"}}}}' ELSE '{{"' || obj || '":{{"' || name || '":' || val || '}}}}' END AS text,
              pkg IS DISTINCT FROM lag(pkg) OVER (PARTITION BY scope ORDER BY ts, event_id) AS moves FROM l)
        SELECT scope, '{{"sync":[' || string_agg(CASE WHEN moves THEN '{{"$pkg":"' || pkg || '"}},' ELSE '' END || text, ',' ORDER BY ts, event_id) || ']}}' AS doc FROM e GROUP BY scope""",
    "events",
)
def _(events):
    return C.wire(_changes(events))


def _changes(events):
    rows = events.sparkSession.sql(_WIRE.format(kind=_KIND, text="STRING", events="{events}"), events=events)
    return rows.withColumn("seq", F.struct("ts", "event_id"))


@over_tables(
    "sync_json_decode",
    f"""WITH l AS ({_WIRE.format(kind=_KIND, text="VARCHAR", events="events")})
        SELECT scope, kind, pkg, obj, name, CASE WHEN kind = 'prop' THEN val END AS val, CASE WHEN kind IN ('new', 'method') THEN args END AS args, CASE WHEN kind = 'method' THEN call_id END AS call_id FROM l""",
    "events",
)
def _(events):
    return C.unwired(C.wire(_changes(events))).drop("at")


@over_tables("ttl_expire", "SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 900 SECOND >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY", "events")
def _(events):
    used = events.groupBy("user_id").agg(F.max("ts").alias("last_used"))
    now = events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("_now"))
    return C.alive(used.crossJoin(F.broadcast(now)), "last_used", F.col("_now")).select("user_id", "last_used")


@over_tables(
    "async_call_join",
    "SELECT c.event_id, r.value AS result, CASE WHEN r.event_id IS NULL THEN 'pending' ELSE 'done' END AS state FROM events c LEFT JOIN (SELECT * FROM events WHERE event_id % 3 = 0) r ON r.event_id = c.event_id WHERE c.event_type = 'view'",
    "events",
)
def _(events):
    results = events.where("event_id % 3 = 0").select("event_id", F.col("value").alias("result"))
    return C.answered(events.where("event_type = 'view'").select("event_id"), results, "event_id").select("event_id", "result", "state")


# Joins by nearness and ranges, aggregates and sets


@over_tables(
    "as_of_join",
    """WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
       SELECT event_id, o_orderkey AS last_order FROM events ASOF LEFT JOIN o ON user_id = o_custkey AND ts >= o_orderdate""",
    "events",
    "orders",
)
def _(events, orders):
    last = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate"), F.col("o_orderkey").alias("last_order"))
    return joins.as_of(events.select("event_id", "user_id", "ts"), last, ["user_id"], "ts", "o_orderdate", ["last_order"]).select("event_id", "last_order")


@over_tables(
    "range_join",
    "SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_acctbal BETWEEN n_nationkey * 400.0 - 1000.0 AND n_nationkey * 400.0 - 300.0",
    "customer",
    "nation",
)
def _(customer, nation):
    bands = nation.select("n_nationkey", (F.col("n_nationkey") * 400.0 - 1000.0).alias("low"), (F.col("n_nationkey") * 400.0 - 300.0).alias("high"))
    return joins.in_ranges(customer, bands, "c_acctbal", "low", "high", 700).select("c_custkey", "n_nationkey")


@over_tables(
    "aggregate_cube",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, count(DISTINCT o_custkey) AS customers,
       CAST(GROUPING(o_orderstatus) * 2 + GROUPING(o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "orders",
)
def _(orders):
    cube = orders.cube("o_orderstatus", "o_orderpriority")
    return cube.agg(
        F.count("*").alias("n"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"),
        F.countDistinct("o_custkey").alias("customers"),
        F.grouping_id().cast("long").alias("level"),
    )


@over_tables(
    "set_operations",
    """SELECT k, 'both' AS part FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL
       SELECT k, 'customer' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT k, 'any' FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders)""",
    "customer",
    "orders",
)
def _(customer, orders):
    a, b = customer.select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k"))
    named = ((a.intersect(b), "both"), (a.subtract(b), "customer"), (a.union(b).distinct(), "any"))
    parts = [rows.withColumn("part", F.lit(name)) for rows, name in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@over_tables("user_aggregate", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS middle FROM part GROUP BY p_brand", "part")
def _(part):
    return part.groupBy("p_brand").agg(F.round(S.geometric_mean("p_retailprice"), 4).alias("middle"))


@over_tables("user_table_function", "SELECT c_custkey, generate_subscripts(parts, 1) - 1 AS place, unnest(parts) AS word FROM (SELECT c_custkey, string_split(c_name || '#' || c_mktsegment, '#') AS parts FROM customer)", "customer")
def _(customer):
    text = customer.select("c_custkey", F.concat("c_name", F.lit("#"), "c_mktsegment").alias("text"))
    return text.lateralJoin(S.split_rows(F.col("text").outer(), F.lit("#"))).select("c_custkey", F.col("place").cast("long").alias("place"), "word")


@over_tables("compare_values", "SELECT c_custkey, CASE WHEN c_custkey % 25 < c_nationkey THEN -1 WHEN c_custkey % 25 > c_nationkey THEN 1 ELSE 0 END AS by_number, CASE WHEN c_name < c_mktsegment THEN -1 WHEN c_name > c_mktsegment THEN 1 ELSE 0 END AS by_text FROM customer", "customer")
def _(customer):
    return customer.select("c_custkey", S.compare(F.col("c_custkey") % 25, F.col("c_nationkey")).alias("by_number"), S.compare(F.col("c_name"), F.col("c_mktsegment")).alias("by_text"))


@over_tables("type_counts", "SELECT event_type AS type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type", "events")
def _(events):
    return C.type_counts(events.select(F.col("event_type").alias("type"), F.col("user_id").alias("obj")))


@over_tables(
    "binding_both_ways",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_retailprice / 2 ELSE p_size * 1.0 END AS net, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2.0 ELSE p_retailprice END AS gross FROM part",
    "part",
)
def _(part):
    side = F.when(F.col("p_partkey") % 3 == 0, "net").when(F.col("p_partkey") % 3 == 1, "gross")
    rows = part.select("p_partkey", F.col("p_size").cast("double").alias("net"), F.col("p_retailprice").alias("gross"), side.alias("changed"))
    return C.bound(rows, "net", "gross", F.col("gross") / 2, F.col("net") * 2, "changed").drop("changed")


@over_tables(
    "reverse_changes",
    """WITH m AS (SELECT o_orderkey, o_custkey AS was, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_custkey ELSE o_custkey + 1 END AS now FROM orders)
       SELECT was AS parent, o_orderkey AS child, 'removed' AS change FROM m WHERE was IS DISTINCT FROM now UNION ALL SELECT now, o_orderkey, 'added' FROM m WHERE was IS DISTINCT FROM now AND now IS NOT NULL""",
    "orders",
)
def _(orders):
    now = F.when(F.col("o_orderkey") % 3 == 1, F.col("o_custkey")).when(F.col("o_orderkey") % 3 == 2, F.col("o_custkey") + 1)
    return C.reverse_changes(orders.select("o_orderkey", F.col("o_custkey").alias("was"), now.alias("now")), "o_orderkey", "was", "now")


@over_tables(
    "json_classes",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Done' WHEN o_orderstatus = 'O' THEN 'Open' ELSE 'Other' END AS class, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS priority FROM orders",
    "orders",
)
def _(orders):
    doc = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(F.lit("Done").alias("class"), F.col("o_totalprice").alias("price"))))
    doc = doc.when(F.col("o_orderstatus") == "O", F.to_json(F.struct(F.lit("Open").alias("class"), F.col("o_orderpriority").alias("priority")))).otherwise(F.lit('{"class":"Other"}'))
    rows = orders.select("o_orderkey", files.typed_json(doc, {"Done": "price double", "Open": "priority string"}).alias("v"))
    return rows.select("o_orderkey", "v.class", "v.Done.price", "v.Open.priority")


_ALTERS = """ALTER TABLE customer ADD COLUMN c_state text DEFAULT 'new'; ALTER TABLE customer ALTER COLUMN c_nationkey TYPE text; ALTER TABLE customer RENAME COLUMN c_name TO c_title;
ALTER TABLE customer DROP COLUMN c_mktsegment; ALTER TABLE customer ALTER COLUMN c_acctbal SET NOT NULL; ALTER TABLE customer ADD CONSTRAINT named CHECK (length(c_title) > 0)"""


@over_tables("ddl_alter", "SELECT c_custkey, c_name AS c_title, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, 'new' AS c_state FROM customer", "customer")
def _(customer):
    return ddl.applied(customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), ddl.parse(_ALTERS))


@over_tables(
    "tx_cascade",
    """WITH c AS (SELECT r_regionkey AS k, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY -1 - r_regionkey) AS id FROM region)
       SELECT c_custkey AS id, c_name AS name, 0 AS orders FROM customer UNION ALL SELECT id, 'NEW_' || k, 1 FROM c""",
    "customer",
    "orders",
    "region",
)
def _(customer, orders, region):
    base = {"c": customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "o": orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))}
    tx = dml.Transaction(base)
    key = (F.lit(-1) - F.col("r_regionkey")).cast("long")
    made = region.select(key.alias("key"), F.concat(F.lit("NEW_"), F.col("r_regionkey").cast("string")).alias("name"))
    lines = region.select((key - 100).alias("key"), key.alias("owner"))
    tx.cascade({"o": dml.New(lines, "key", "id", {"owner": "c"}), "c": dml.New(made, "key", "id")})
    top = orders.agg(F.max("o_orderkey").alias("_top"))
    new = tx.read("o").crossJoin(F.broadcast(top)).where("id > _top").groupBy(F.col("owner").alias("_of")).agg(F.count("*").alias("orders"))
    return tx.read("c").join(new, F.col("id") == F.col("_of"), "left").select("id", "name", F.coalesce("orders", F.lit(0)).cast("int").alias("orders"))
