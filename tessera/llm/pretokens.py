"""Splitting texts into units that a tokenizer treats alone, so that its work is done once per distinct unit.

A unit is a word with the space before it, or a run of white space. For plain Latin texts a short regular
expression finds the units; any other text goes through the library as a whole, so results never differ.
"""

from __future__ import annotations

import json
import os
import re
import string
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts of these characters only: their white space is space, tab and line breaks, NFC leaves them as they are,
#: and lower-casing works character by character.
PLAIN = re.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u017f]*").fullmatch
#: Byte-level pre-tokenizers give the last space of a run to the word after it.
UNITS = re.compile(r"\s+(?!\S)| ?\S+|\s").findall


@lru_cache(maxsize=8)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=8)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def plain(text: str, path: str) -> bool:
    """Whether the units of text can be tokenized one by one."""
    return PLAIN(text) is not None and not ("<|" in text and any(s in text for s in special_strings(path)))


def between_specials(text: str, path: str) -> tuple[list[str], list[str]]:
    """The stretches of text between special strings, and the special strings found."""
    found = special_strings(path)
    if not found:
        return [text], []
    parts = re.split("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")", text)
    return parts[::2], parts[1::2]


def library_pretokens(text: str, path: str) -> list[str]:
    """The pieces of text (without special strings) that the tokenizer's own splitter makes."""
    return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


#: ASCII marks that end a pre-token of letters and stand together as one; an apostrophe may begin an ending of its own.
_MARKS = string.punctuation.replace("'", "")


@lru_cache(maxsize=8)
def whole_words(path: str) -> bool:
    """Whether the tokenizer's splitter is the usual one of byte-level vocabularies: a word of letters alone, with or without a
    space before it, is one pre-token, and a run of marks after it another."""
    with open(path, encoding="utf-8") as f:
        splitter = json.load(f)["pre_tokenizer"] or {}
    return splitter.get("type") == "ByteLevel" and bool(splitter.get("use_regex")) and not splitter.get("add_prefix_space")


def unit_pretokens(unit: str, path: str) -> list[str]:
    """The pre-tokens of a unit of a plain text."""
    if whole_words(path):
        head = unit.rstrip(_MARKS)
        if head.removeprefix(" ").isalpha():
            return [unit] if len(head) == len(unit) else [head, unit[len(head) :]]
    return library_pretokens(unit, path)
