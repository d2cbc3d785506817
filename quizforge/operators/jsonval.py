"""Generated items: JSON extraction, schema rules, structure rules, key moves."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import BANNED, indel_ratio

LETTERS = ("A", "B", "C", "D")
ITEM = "stem string, stimulus string, choices map<string,string>, answer string, explanation string, lo_id string, difficulty string"
DIFFICULTIES = ("easy", "medium", "hard")
# Words that make the letter after them part of a name.
NAMES = set("vitamin type allele point factor wave stage phase hepatitis group class band zone region site horizon layer".split())
_PIECE = re.compile(r'"(?:\\.|[^"\\])*(?:"|$)|[{}]', re.S)


def balanced(text: str | None) -> str | None:
    """The first balanced {...}; braces within strings don't count. A '{' never closed is skipped.

    Strings and braces are the only pieces that matter; each is +1, -1 or 0, and the sum is 0 where the object ends.
    """
    for opening in re.finditer(r"\{", text or ""):
        level = 0
        for piece in _PIECE.finditer(text, opening.start()):
            level += (piece[0] == "{") - (piece[0] == "}")
            if not level:
                return text[opening.start() : piece.end()]
    return None


@F.pandas_udf(StringType())
def extract_json(s: pd.Series) -> pd.Series:
    return s.map(balanced)


@F.pandas_udf(StringType())
def extract_verdict(s: pd.Series) -> pd.Series:
    """The last JSON object whose three verdicts are booleans, as text."""
    keys, decoder = ("key_correct", "lo_fit", "distractors_plausible"), json.JSONDecoder()

    def last(text: str | None) -> str | None:
        for m in reversed(list(re.finditer(r"\{", text or ""))):
            try:
                found, end = decoder.raw_decode(text, m.start())
            except ValueError:
                continue
            if isinstance(found, dict) and all(isinstance(found.get(k), bool) for k in keys):
                return text[m.start() : end]
        return None

    return s.map(last)


def parse_reason(block: Column) -> Column:
    """no_json, bad_json (not an object too), or null."""
    kind = F.schema_of_variant(F.try_parse_json(block))
    return F.when(block.isNull(), "no_json").when(F.try_parse_json(block).isNull() | ~kind.startswith("OBJECT"), "bad_json")


def schema_errors(block: Column) -> Column:
    """The names of broken rules: required and extra keys on both levels, lengths, enums."""
    item, keys = F.from_json(block, ITEM), F.json_object_keys(block)
    need = F.array(*map(F.lit, ("stem", "choices", "answer", "explanation", "lo_id", "difficulty")))
    rules = [
        (F.size(F.array_except(need, keys)) > 0, "required"),
        (F.size(F.array_except(keys, F.array_append(need, F.lit("stimulus")))) > 0, "extra"),
        (F.array_sort(F.map_keys(item["choices"])) != F.array(*map(F.lit, LETTERS)), "choices"),
        (~item["answer"].isin(*LETTERS), "answer"),
        (~item["difficulty"].isin(*DIFFICULTIES), "difficulty"),
        ((F.length(item["stem"]) < 10) | (F.length(item["stem"]) > 600), "stem_length"),
        (F.exists(F.map_values(item["choices"]), lambda c: (F.length(c) < 1) | (F.length(c) > 200)), "choice_length"),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in rules)), lambda x: x.isNotNull())


def distinct_key(options: Column, key: Column) -> Column:
    """Whether the key's text, trimmed and lower-cased, stands once among the options."""
    return F.size(F.filter(options, lambda o: F.lower(F.trim(o)) == F.lower(F.trim(key)))) == 1


def structure_problems(options: Column, key: Column, stem: Column) -> Column:
    """Pairs of options at least 90 similar, banned phrases, the key as whole words in the stem."""
    pairs = [indel_ratio(F.lower(F.get(options, i)), F.lower(F.get(options, j))) >= 90 for i in range(4) for j in range(i + 1, 4)]
    near = pairs[0]
    for p in pairs[1:]:
        near = near | p
    inside = (F.length(key) > 3) & F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower(stem), "[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(key), "[^a-z0-9]+", " ")), F.lit(" ")))
    return F.filter(F.array(F.when(near, "similar_options"), F.when(F.exists(options, lambda o: o.rlike(BANNED)), "banned_phrase"), F.when(inside, "key_in_stem")), lambda x: x.isNotNull())


def misconception_present(options: Column, key: Column, target: Column) -> Column:
    wrong = F.filter(options, lambda o: o != key)
    return target.isNull() | F.exists(wrong, lambda o: indel_ratio(F.lower(o), F.lower(target)) >= 85)


def rotations(letters: Column) -> Column:
    """(k, new, old): for each cyclic shift the letter that stands for each old one."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform(letters, lambda x, i: F.struct(k.alias("k"), x.alias("new"), F.get(letters, (i + k) % 4).alias("old")))))


_WORD = re.compile(r"[\w'-]+|[^\w\s'-]")
_OPTION, _IS = {"option", "options", "choice", "choices", "answer", "answers"}, {"answer", "option", "choice"}


class Letters:
    """The lone capitals A-D of an explanation, each put in a class by the words around it.

    move: it stands for an option and may be rewritten; stay: it belongs to a name; other: neither is sure.
    """

    def __init__(self, text: str):
        self.text = text
        self.words = [(m[0], m.start()) for m in _WORD.finditer(text)]
        self.kind: dict[int, str] = {}  # place in the text -> class
        listed = False  # the letter before is one of a list of options
        for i, (word, at) in enumerate(self.words):
            if word in LETTERS:
                kind = self._of(i, listed)
                self.kind[at] = kind
                listed = kind == "listed" or listed
            elif not (listed and word in (",", "and", "or")):
                listed = False

    def _near(self, i: int) -> str:
        return self.words[i][0] if 0 <= i < len(self.words) else ""

    def _of(self, i: int, listed: bool) -> str:
        at, before, after = self.words[i][1], self._near(i - 1), self._near(i + 1)
        gap = at > 0 and self.text[at - 1].isspace()
        if before.lower() in NAMES and gap:
            return "stay"
        if before.lower() in _OPTION and gap or listed:
            return "listed"
        if before.lower() == "is" and self._near(i - 2).lower() in _IS and gap:
            return "move"
        if after.lower() == "is" and self._near(i + 2).lower() in ("correct", "incorrect"):
            return "move"
        if self.text[at - 1 : at] == "(" and self.text[at + 1 : at + 2] == ")":
            return "move"
        opens = at == 0 or self.text[at - 1] == "\n" or gap and self.text[at - 2 : at - 1] == "."
        return "move" if opens and self.text[at + 1 : at + 2] in (":", ")") else "other"


def unhandled(text: str, letters: tuple[str, ...] = LETTERS) -> list[str]:
    """Lone capitals A-D that can't be put in a class, but for the article before a lower-case word."""
    article = lambda at: text[at] == "A" and re.match(r"\s+[a-z]", text[at + 1 :])
    return [text[at] for at, kind in Letters(text).kind.items() if kind == "other" and text[at] in letters and not article(at)]


def rewritten(text: str, old: str, new: str) -> str | None:
    """The explanation after options old and new changed places; null if a letter can't be rewritten safely."""
    if old == new:
        return text
    if unhandled(text, (old, new)):
        return None
    out = list(text)
    for at, kind in Letters(text).kind.items():
        if kind in ("move", "listed"):
            out[at] = {old: new, new: old}.get(out[at], out[at])
    return "".join(out)


@F.pandas_udf(StringType())
def move_explanation(text: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else rewritten(t, a, b) for t, a, b in zip(text, old, new, strict=True)], dtype=object)


def move_choices(choices: Column, old: Column, new: Column) -> Column:
    return F.transform_values(choices, lambda k, v: F.when(k == old, choices[new]).when(k == new, choices[old]).otherwise(v))
