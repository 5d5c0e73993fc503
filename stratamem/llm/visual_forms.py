"""One consistent form for texts that look the same.

Compatibility forms, composed or separate accents, kinds of space and invisible characters
are made one. Then each run of letters is resolved by script: every letter stands for the
scripts it is used in (the Unicode property Script_Extensions) and those in which a letter of
its shape exists, the sets are intersected over the run, and the run is spelled in the script that remains. A run with no common script is mixed beyond repair
and takes the Latin shapes letter by letter; a run that could be spelled whole in several
scripts takes the script that the text's unambiguous letters mostly have.

The result depends on the shapes alone, so two texts that look the same get equal forms.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from stratamem.session import materialize

# Letters of the same shape, position by position.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԚԜԌаеѕіјорсухһԁԛԝѵɡӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYQWGaesijopcyxhdqwvgl"
#: Those that a word of today is spelled with.
CYRILLIC_USUAL = "АВЕЅІЈКМНОРСТУХаеѕіјорсух"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϳ"
GREEK_AS = "ABEZHIKMNOPTYXaivopuj"
LATIN = "ɑɩ"
LATIN_AS = "ai"
SPACES = "              　 "

_SHAPE = str.maketrans(CYRILLIC + GREEK + LATIN + SPACES, CYRILLIC_AS + GREEK_AS + LATIN_AS + " " * len(SPACES))
_TO = {
    "Cyrillic": {a: c for c, a in zip(CYRILLIC, CYRILLIC_AS) if c in CYRILLIC_USUAL},
    "Greek": dict(zip(GREEK_AS[:-1], GREEK[:-1])),
}
_RESPELL = {script: str.maketrans(table) for script, table in _TO.items()}
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻]")
_OTHER = re.compile("[Ͱ-ԯἀ-῿Ⰰ-ⷿꙀ-ꚟ]")
_RUN = re.compile(r"(?:[^\W\d_]|[̀-ͯ])+")


#: Scripts told apart; a character of none of them is a script of its own plane and block.
SCRIPTS = (
    "Latin Greek Cyrillic Armenian Georgian Cherokee Coptic Glagolitic Hebrew Arabic Syriac Thaana Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu "
    "Kannada Malayalam Sinhala Thai Lao Tibetan Myanmar Ethiopic Khmer Mongolian Han Hiragana Katakana Bopomofo Hangul Canadian_Aboriginal Lisu Vai Nko Tifinagh"
).split()
_EXTENSIONS = [(s, regex.compile(rf"\p{{scx={s}}}")) for s in SCRIPTS]
_ANY = regex.compile(r"[\p{sc=Common}\p{sc=Inherited}]")
#: Writing systems that mix scripts by nature.
_TOGETHER = {"Han": {"Japanese", "Korean", "Chinese"}, "Hiragana": {"Japanese"}, "Katakana": {"Japanese"}, "Hangul": {"Korean"}, "Bopomofo": {"Chinese"}}


@lru_cache(maxsize=1 << 16)
def script_set(ch: str) -> frozenset[str] | None:
    """The scripts a character is used in, by the Unicode property Script_Extensions, with the writing systems that mix them; None for all."""
    own = {s for s, p in _EXTENSIONS if p.match(ch)}
    if not own:
        return None if _ANY.match(ch) else frozenset({f"block {ord(ch) >> 7:x}"})
    return frozenset(own.union(*(_TOGETHER.get(s, set()) for s in own)))


def resolved_scripts(run: str) -> frozenset[str] | None:
    """The scripts common to all characters of a run: empty if it is mixed, None if any script will do."""
    out = None
    for ch in run:
        own = script_set(ch)
        if own is not None:
            out = own if out is None else out & own
    return out


def scripts_of(run: str) -> tuple[set[str], Counter]:
    """Scripts in which the whole run (in Latin shapes) can be spelled; its unambiguous letters by script."""
    able, sure = {"Latin", "Cyrillic", "Greek"}, Counter()
    for ch in run:
        if unicodedata.combining(ch):
            continue
        own = script_set(ch)
        if own is None:
            continue
        can = own | {s for s, table in _TO.items() if ch in table}
        able &= can
        if len(can) == 1:
            sure[next(iter(can))] += 1
    return able, sure


def verdicts(text: str) -> tuple[int, int]:
    """Runs of letters as they stand: how many are mixed (no script common to all letters), and how many of a Greek or Cyrillic run could be Latin as a whole."""
    if text.isascii():
        return 0, 0
    mixed = whole = 0
    for run in _RUN.findall(INVISIBLE.sub("", text)):
        if not run.isascii():
            scripts = resolved_scripts(run)
            mixed += scripts == frozenset()
            whole += bool(scripts) and bool(scripts & {"Greek", "Cyrillic"}) and "Latin" not in scripts and "Latin" in scripts_of(shapes(run))[0]
    return mixed, whole


def shapes(text: str) -> str:
    """Decomposed text with every look-alike letter in its Latin shape and nothing invisible."""
    text = unicodedata.normalize("NFKD", INVISIBLE.sub("", text))
    return INVISIBLE.sub("", text).translate(_SHAPE)


def consistent_form(text: str) -> str:
    if text.isascii():
        return text
    plain = shapes(text)
    if _OTHER.search(plain):
        overall: Counter = Counter()
        found: dict[str, tuple[set[str], Counter]] = {}
        for run in _RUN.findall(plain):
            if run not in found:
                found[run] = scripts_of(run)
            overall.update(found[run][1])
        main = max(("Latin", "Cyrillic", "Greek"), key=lambda s: overall[s])

        def spell(m: re.Match) -> str:
            able, _ = found[m.group()]
            to = main if main in able else "Latin" if "Latin" in able or not able else sorted(able)[0]
            return m.group().translate(_RESPELL[to]) if to != "Latin" else m.group()

        plain = _RUN.sub(spell, plain)
    return unicodedata.normalize("NFC", plain)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        high, low, own = [], [], []
        for text in batch.column(1).to_pylist():
            raw = text.encode()
            h = xxhash.xxh3_128_intdigest(consistent_form(text).encode())
            high.append((h >> 64) - (1 << 63))
            low.append((h & (2**64 - 1)) - (1 << 63))
            own.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(own, pa.int64())], names=["rec_id", "high", "low", "own"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        forms = [None if t is None else consistent_form(t) for t in texts]
        runs = [(None, None) if t is None else verdicts(t) for t in texts]
        changed = [None if t is None else t != f for t, f in zip(texts, forms)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(forms, pa.string()), pa.array(changed, pa.bool_()), *(pa.array([r[k] for r in runs], pa.int32()) for k in (0, 1))],
            names=["rec_id", "form", "changed", "mixed_runs", "whole_runs"],
        )


def consistent_forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rec_id, form, changed, mixed_runs, whole_runs)``, one row per input row; a null text has null results."""
    src = df.select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text"))
    kind = src.schema["rec_id"].dataType.simpleString()
    return src.mapInArrow(_forms, f"rec_id {kind}, form string, changed boolean, mixed_runs int, whole_runs int")


def look_alikes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_a, doc_b)``: ids whose texts differ but have one consistent form, smaller id first.

    Only hashes are shuffled. Forms under which all texts are equal (repeated uploads) leave
    first; different texts of a form are paired once each, whatever the number of their
    uploads, and uploads join those pairs, so no rows meet that are not in the result. Null ids or texts take no part; repeated rows count once.
    """
    src = df.select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text")).where("rec_id is not null and text is not null")
    kind = src.schema["rec_id"].dataType.simpleString()
    marks = materialize(src.mapInArrow(_hashes, f"rec_id {kind}, high bigint, low bigint, own bigint"), "forms")
    form = ["high", "low"]
    texts = marks.groupBy(*form, "own").agg(F.count("*").alias("n"))  # one row a text, however often it was uploaded
    varied = texts.groupBy(*form).agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").select(*form)
    kept = texts.join(varied, form, "left_semi")
    pairs = kept.select(*form, F.col("own").alias("own_a")).join(kept.select(*form, F.col("own").alias("own_b")), form).where("own_a < own_b")
    ids = marks.join(varied, form, "left_semi").select(*form, "own", "rec_id").distinct()
    a = pairs.join(ids.select(*form, F.col("own").alias("own_a"), F.col("rec_id").alias("a")), [*form, "own_a"])
    both = a.join(ids.select(*form, F.col("own").alias("own_b"), F.col("rec_id").alias("b")), [*form, "own_b"]).where("a <> b")
    return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()
