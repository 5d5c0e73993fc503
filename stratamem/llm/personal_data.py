"""Finding personal information in free text and replacing it with typed placeholders.

E-mail addresses, phone numbers, identity numbers and street addresses have forms and are
found by them. Names have none: how strongly a term reveals a person is estimated from what
it occurs with in the corpus. First contexts are weighed: the two tokens before or behind a
capitalised run (an item found by form counts as one token of its kind), by the share of
their runs that are listed names, and by how many different listed names they are seen with.
Contexts over the threshold, and titles, are person slots. Then terms are weighed by the share
of their occurrences in person slots, smoothed for rare terms; the logarithm of that share over
the corpus-wide one is the pointwise mutual information of term and slot. Terms over the
disclosure threshold, and the listed names, disclose by themselves; where one stands in a
slot, or next to another one, it is a person. Listed terms that are also ordinary words need
such a place, which their statistics tell.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratamem.session import materialize

KINDS = ("email", "phone", "identity", "address", "name")

# Words that announce items.
TITLES = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Dame|Herr|Frau|Señor|Señora|Sr|Sra|Mme|Mlle|Monsieur|Madame)"
STREET_WORDS = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Way|Close|Terrace|Boulevard|Blvd|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Crescent|Row|Hill|Gardens|Grove|Mews|Parade|Quay|Alley|Walk)"
ID_CUES = r"(?:passport|identity|\bID\b|id card|ssn|social security|national insurance|\bNI\b|insurance|licen[cs]e|document|personal number|tax number|nino|visa)"
ORGANISATIONS = r"(?:Foundation|Institute|Museum|Company|Corporation|Corp|Inc|Ltd|GmbH|Group|University|College|School|Hospital|Library|Society|Association|Council|Bank|Trust|Club|Church|Theatre|Partners|Brothers|Sons|Labs?|Studios?|Press)"
TITLE_WORDS = frozenset("mr mrs ms miss mx dr prof sir dame herr frau sr sra mme mlle".split())
NOT_NAMES = frozenset(
    "I A The This That These Those It Its He She We You They My Your His Her Our Their Who What When Where Why How Which Is Are Was Were Do Does Did Can Could "
    "Will Would Should May Might Must Please Thanks Thank Hello Hi Hey Dear Okay Ok Yes No Not Sure Noted Nobody Everyone Everybody Someone Anyone There Here "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December "
    "And Or But If So As At By For From In Of On To With Cc Bcc Re Fwd Call Ring Ask Tell Ship Send Signed Emergency Contact Passport Number Street Road Flat Apt Box "
    "Block Room Route Ratio Serial Part Due Order Tracking Score Version Hope Mark Grace Rose Reed Street Every Never Left Has Had Have Just Also Then Now Ssn".split()
) - frozenset("Hope Mark Grace Rose Reed May".split())

_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+'-]*"
_AT = r"(?:\s*@\s*|\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?<![\w.@])(?P<item>{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}(?P<top>[A-Za-z]{{2,24}}))(?![\w@])", re.I)
_SPELLED = re.compile(rf"(?<![\w.@])(?P<item>[A-Za-z0-9](?:[A-Za-z0-9._%+'-]|\s+(?:dot|underscore|dash)\s+)*\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})*\s+dot\s+(?P<top>[A-Za-z]{{2,24}}))(?![\w@])", re.I)
_FILE_ENDINGS = frozenset("png jpg jpeg gif svg webp pdf txt csv json zip html css js py md".split())

PHONE = re.compile(
    r"(?<![\w.,/-])(?P<item>\+?(?:\(\+?\d{1,5}\)[ .\-/]?|\d)[\d]*(?:(?:[ .\-/]|[ .\-/]?\(\d{1,5}\)[ .\-/]?)?\d+)+)(?!\w)"
)
_PHONE_CUE = re.compile(r"(?:\b(?:tel|phone|ph|call|ring|mobile|mob|cell|fax|backup|whatsapp|dial|text|reach me|number changed|remember)\b(?:\W+\w+){0,3}\W*$)", re.I)
_LOCAL_CUE = re.compile(r"\b(?:tel|phone|telephone|call|ring|mobile|mob|cell|fax|dial|whatsapp)\b\.?(?: (?:me|us|him|her|them))?(?: (?:on|at|under|is|number))*[ :]*$", re.I)

_ID_FORMS = [
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",  # national insurance
    r"9\d{2}[- ]?\d{2}[- ]?\d{4}",
    r"\d{3}[- ]\d{2}[- ]\d{4}",
    r"\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}",
    r"\d{6}-\d{5}",
    r"[A-Z]{1,2}\d{7,8}",
    r"[A-Z]{2} \d{3} \d{4}",
    r"[A-Z]\d{8}[A-Z]?",
    r"\d{9}",
]
IDENTITY = re.compile(r"(?<![\w#/@.-])(?P<item>" + "|".join(f"(?:{x})" for x in _ID_FORMS) + r")(?![\w/]|[-.]\d)", re.I)
_ID_CUE = re.compile(ID_CUES, re.I)
_NOT_ID_CUE = re.compile(r"(?:order|tracking|serial|isbn|part|batch|score|version|invoice|ticket|route|ratio|model|sku|reference|ref)\b[^.!?\n]{0,24}$", re.I)

_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|No)\.? ?\d{1,4}[A-Za-z]?(?:,? ))"
_HOUSE = r"\d{1,4} ?(?:bis|ter|[a-zA-Z](?![A-Za-z]))?"
_TOWN = re.compile(r",[ \u00a0]+(?:\d{4,5} )?(?P<town>[^\W\d_]{2,}(?:-[^\W\d_]+)*)(?: [A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b)?")
ADDRESS = re.compile(
    r"(?<![\w/.-])(?P<item>"
    rf"{_UNIT}?{_HOUSE},? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s(?:de la |de l['’]|des |du |de |d['’])?[^\W\d_][\w'’-]*"
    rf"|{_UNIT}?{_HOUSE},? (?:(?!(?:the|an?|of|in|on|at|for|to|down|up|and|minutes?|hours?|walk|miles?|km|mm|by)\b)[^\W\d_][\w'’-]*\s){{1,3}}{STREET_WORDS}\b\.?"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Via|Viale|Piazza|Rua|ul\.|ulica)\s(?:de la |de los |del |de )?[^\W\d_][\w'’-]*(?:\s[^\W\d_][\w'’-]*)?,? \d{{1,4}}[a-zA-Z]?\b"
    r"|[^\W\d_]+(?:straße|strasse|str\.|weg|gasse|allee|platz)\s\d{1,4}[a-zA-Z]?\b"
    r"|P\.? ?O\.? ?Box \d{1,6}\b|PO Box \d{1,6}\b|Postfach \d{1,6}\b"
    r")",
    re.I,
)


#: Every kind of space within a line, dash or apostrophe in its plain form, one for one.
_PLAIN = {c: " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)} | {c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2013)} | {0x2019: "'"}


def plain(text: str) -> str:
    """The text with odd spaces, hyphens and apostrophes made plain; offsets stay."""
    return text if text.isascii() else text.translate(_PLAIN)


def _overlaps(spans: list[tuple[int, int, str]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e, _ in spans)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    if "@" in text or re.search(r"[\[({<]\s*at\b", low):
        for m in EMAIL.finditer(text):
            if m["top"].lower() not in _FILE_ENDINGS:
                yield m.span("item")
    if re.search(r"\bat\b", low) and re.search(r"\bdot\b", low):
        for m in _SPELLED.finditer(text):
            yield m.span("item")


def _phone_like(item: str, before: str, after: str) -> bool:
    digits = re.sub(r"\D", "", item)
    if not 7 <= len(digits) <= 15:
        return False
    if item.startswith(("+", "00")) and not re.match(r"0{3}", item):
        return True
    cue = bool(_PHONE_CUE.search(before[-40:]))
    if _NOT_ID_CUE.search(before[-48:]) and not cue:
        return False
    if not re.fullmatch(r"\d{3}([-. ])\d{3}\1\d{4}", item) and re.fullmatch(r"\d{4}-\d{2}-\d{2}|\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?|\d{1,2}[./]\d{1,2}[./]\d{2,4}", item):
        return False
    if item.startswith("("):
        return len(digits) >= 9
    if re.fullmatch(r"0[1-9]\d{0,3}[ /.-]?\d{3,8}(?:[ /.-]\d{2,6})*", item) and len(digits) >= 9:
        return True
    if re.fullmatch(r"0\d(?:[ .]\d{2}){4}", item) or re.fullmatch(r"\d{3}[-. ]\d{3}[-. ]\d{4}", item):
        return True
    if _LOCAL_CUE.search(before[-24:]):  # a local number, right behind its cue
        return True
    return len(digits) >= 9 and (cue or (before.endswith("(") and after.startswith(")")))


_EXTENSION = re.compile(r",?\s?(?:ext|extension|x|Durchwahl)\.?\s?\d{1,6}\b", re.I)


def _phones(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        s, e = m.span("item")
        if not _overlaps(spans, s, e) and _phone_like(text[s:e], text[:s], text[e:]):
            ext = _EXTENSION.match(text, e)
            yield s, ext.end() if ext else e


_STRONG_ID = re.compile(r"\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}|\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{6}-\d{5}", re.I)


def _identities(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    for m in IDENTITY.finditer(text):
        s, e = m.span("item")
        if _overlaps(spans, s, e):
            continue
        before = text[max(0, s - 45) : s]
        if _NOT_ID_CUE.search(before):
            continue
        if _ID_CUE.search(before) or re.match(r"[^.!?\n]{0,4}\bexpires\b", text[e : e + 20]) or _STRONG_ID.fullmatch(m.group("item")):
            yield s, e


def _addresses(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    for m in ADDRESS.finditer(text):
        s, e = m.span("item")
        if not _overlaps(spans, s, e):
            town = _TOWN.match(text, e)
            real = town and town["town"].title() not in NOT_NAMES and not _overlaps(spans, e, town.end()) and not text.startswith("@", town.end())
            yield s, town.end() if real else e


def structured_items(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the items that have a form of their own, by place."""
    text = plain(text)
    spans: list[tuple[int, int, str]] = []
    for s, e in _emails(text):
        if not _overlaps(spans, s, e):
            spans.append((s, e, "email"))
    if any(ch.isdigit() for ch in text):
        spans += [(s, e, "address") for s, e in _addresses(text, spans)]
        # A form of identity number near its cue wins over a telephone reading of the digits.
        spans += [(s, e, "identity") for s, e in _identities(text, spans)]
        spans += [(s, e, "phone") for s, e in _phones(text, spans)]
    return sorted(spans)


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ORG_AFTER = re.compile(rf"(?:-[^\W\d_]+)?(?:\s+(?:and|&)\s+\w+)?\s+(?:[^\W\d_]+\s)?(?:{ORGANISATIONS}|{STREET_WORDS})\b")
_TITLE_BEFORE = re.compile(r"\b" + TITLES + r"\.?\s+$", re.I)
_CONTEXT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")
_SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|\n|\s{2,}")
#: Tokens of a context, which ends where the sentence does, and characters that they are looked for in.
NEAR, REACH = 2, 32


def _tokens(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group().replace("’", "'").casefold()) for m in _WORD.finditer(text) if not _overlaps(taken, m.start(), m.end())]


def _is_initial(text: str, s: int, e: int) -> bool:
    return e - s == 1 and text[s].isupper() and text[e : e + 1] == "."


def _joined(gap: str) -> bool:
    return gap in (" ", "-", ", ", ". ") or (gap.isspace() and "\n" not in gap and len(gap) <= 2)


def _stretches(text: str, tokens: list[tuple[int, int, str]], chosen: list[bool]) -> Iterator[list[int]]:
    """Runs of chosen tokens, initials between them included, that spaces, hyphens or commas join."""
    run: list[int] = []
    for i, (s, e, _) in enumerate(tokens):
        if not (chosen[i] or _is_initial(text, s, e)):
            if run:
                yield run
            run = []
            continue
        if run:
            prev = tokens[run[-1]]
            gap = text[prev[1] : s]
            if not _joined(gap) or (gap == ". " and not _is_initial(text, prev[0], prev[1])):
                yield run
                run = []
        run.append(i)
    if run:
        yield run


def _context(parts: list[str]) -> str:
    return " ".join("0" if t.isdigit() else t.lower() for t in parts)


def contexts(text: str, spans: list[tuple[int, int, str]], start: int, end: int) -> tuple[str, str]:
    """What stands right before and right behind a run: two tokens each, fewer at the ends of its sentence."""
    before = next((f"<{kind}> {text[e:start].strip()}" for s, e, kind in spans if start - 3 <= e <= start and not _SENTENCE_END.search(text[e:start])), None)
    behind = next((f"{text[end:s].strip()} <{kind}>" for s, e, kind in spans if end <= s <= end + 3 and not _SENTENCE_END.search(text[end:s])), None)
    if before is None:
        parts = _CONTEXT.findall(_SENTENCE_END.split(text[max(0, start - REACH) : start])[-1])
        before = _context(parts[-NEAR:] if len(parts) >= NEAR else ["^", *parts])
    if behind is None:
        parts = _CONTEXT.findall(_SENTENCE_END.split(text[end : end + REACH])[0])
        behind = _context(parts[:NEAR] if len(parts) >= NEAR else [*parts, "$"])
    return "L " + before, "R " + behind


def _in_slot(text: str, spans: list[tuple[int, int, str]], start: int, end: int, slots: frozenset[str]) -> bool:
    if _TITLE_BEFORE.search(text[max(0, start - REACH) : start]):
        return True
    return bool(slots) and not slots.isdisjoint(contexts(text, spans, start, end))


def text_evidence(text: str, listed: frozenset[str]) -> tuple[list[tuple[int, int, str]], list[tuple], list[tuple[str, int]], list[str]]:
    """What one text tells: items found by form, capitalised runs, terms with their occurrences, and contexts to look up.

    A run is ``(left, right, words, listed, titled)``. A term counts whatever its case; runs
    are capitalised words outside the items. Names of organisations or streets are not
    counted at all.
    """
    text = plain(text)
    spans = structured_items(text)
    tokens = _tokens(text, spans)
    chosen = [text[s].isupper() and w not in TITLE_WORDS and not (w.title() in NOT_NAMES and w not in _ALSO_NAMES) and e - s > 1 for s, e, w in tokens]
    counts: dict[str, int] = {}
    runs, asked, out = [], set(), set()
    for run in _stretches(text, tokens, chosen):
        start, end = tokens[run[0]][0], tokens[run[-1]][1]
        if _ORG_AFTER.match(text, end):
            out.update(run)
            continue
        words = [tokens[i][2] for i in run if chosen[i]]
        left, right = contexts(text, spans, start, end)
        titled = bool(_TITLE_BEFORE.search(text[max(0, start - REACH) : start]))
        runs.append((left, right, words, all(w in listed for w in words), titled))
        asked |= {left, right}
        if len(run) > 1:
            for i in run:
                asked.update(contexts(text, spans, tokens[i][0], tokens[i][1]))
    for i, (s, e, w) in enumerate(tokens):
        if w in listed and text[s].islower():
            asked.update(contexts(text, spans, s, e))
        if e - s > 1 and i not in out:
            counts[w] = counts.get(w, 0) + 1
    return spans, runs, list(counts.items()), sorted(asked)


#: Words of the list above that are names as well.
_ALSO_NAMES = frozenset("hope mark grace rose reed may june april".split())
#: A context is a person slot if this share of its runs are listed names, of so many kinds at least.
SLOT, KINDS_IN_SLOT = 0.5, 3
#: A term discloses a person if this share of its occurrences, smoothed, is in person slots.
DISCLOSURE = 0.1
#: Below this share a name is also an ordinary word, and counts only in a slot or beside another name.
UNAMBIGUOUS = 0.6
#: Occurrences added at the corpus-wide rate when a term's share is estimated.
PRIOR = 1.0


def names_in(text: str, spans: list[tuple[int, int, str]], terms: dict[str, tuple[float, str | None]], slots: frozenset[str]) -> list[tuple[int, int, str]]:
    """Items of kind name. ``terms`` gives each disclosing term's share and, if listed, its part; ``slots`` the contexts that are person slots."""
    text = plain(text)
    tokens = _tokens(text, spans)
    chosen = [w in terms for _, _, w in tokens]
    found = []
    for run in _stretches(text, tokens, chosen):
        for part in _people(text, tokens, run, terms):
            while part and not chosen[part[-1]]:
                part = part[:-1]
            named = [i for i in part if chosen[i]]
            if not named:
                continue
            start, end = tokens[part[0]][0], tokens[part[-1]][1]
            if _ORG_AFTER.match(text, end) and not _TITLE_BEFORE.search(text[max(0, start - REACH) : start]):
                continue
            strong = [i for i in named if terms[tokens[i][2]][0] >= UNAMBIGUOUS]
            upper = all(text[tokens[i][0]].isupper() for i in named)
            slot = _in_slot(text, spans, start, end, slots)
            if upper and (slot or strong or (len(named) >= 2 and len(part) >= 2)) or (not upper and len(named) >= 2 and (strong or slot)):
                found.append((start, end, "name"))
    return found


def _people(text: str, tokens: list[tuple[int, int, str]], run: list[int], terms: dict[str, tuple[float, str | None]]) -> Iterator[list[int]]:
    """A run cut at commas, except between a family name and the given name after it."""
    part = run[:1]
    for a, b in zip(run, run[1:]):
        gap = text[tokens[a][1] : tokens[b][0]]
        comma = "," in gap
        kind = [terms.get(tokens[i][2], (0, None))[1] for i in (a, b)]
        if comma and (kind[0] == "given" or kind[1] == "family" or any("," in text[tokens[x][1] : tokens[y][0]] for x, y in zip(part, part[1:]))):
            yield part
            part = []
        part.append(b)
    yield part


def placeholder(kind: str) -> str:
    return f"[{kind.upper()}]"


def sanitized(text: str, items: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in sorted(items):
        if s >= at:
            out += [text[at:s], placeholder(kind)]
            at = e
    return "".join(out) + text[at:]


_SPAN = pa.struct([("start_pos", pa.int64()), ("end_pos", pa.int64()), ("kind", pa.string())])
_RUN = pa.struct([("left", pa.string()), ("right", pa.string()), ("words", pa.list_(pa.string())), ("listed", pa.bool_()), ("titled", pa.bool_())])
_COUNT = pa.struct([("term", pa.string()), ("n", pa.int64())])
_SPANS = "array<struct<start_pos: bigint, end_pos: bigint, kind: string>>"
_EVIDENCE = f"text string, spans {_SPANS}, runs array<struct<left: string, right: string, words: array<string>, listed: boolean, titled: boolean>>, terms array<struct<term: string, n: bigint>>, asked array<string>"


def _evidence(listed: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [([], [], [], []) if t is None else text_evidence(t, listed) for t in batch.column(2).to_pylist()]
            columns = [
                pa.array([[dict(zip(("start_pos", "end_pos", "kind"), x)) for x in f[0]] for f in found], pa.list_(_SPAN)),
                pa.array([[dict(zip(("left", "right", "words", "listed", "titled"), x)) for x in f[1]] for f in found], pa.list_(_RUN)),
                pa.array([[dict(zip(("term", "n"), x)) for x in f[2]] for f in found], pa.list_(_COUNT)),
                pa.array([f[3] for f in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["row", "rec_table", "text", "spans", "runs", "terms", "asked"])

    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text, spans, terms, slots in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            if text is None:
                found.append(None)
                continue
            spans = [(x["start_pos"], x["end_pos"], x["kind"]) for x in spans]
            if terms:
                spans += names_in(text, spans, {t["term"]: (t["share"], t["part"]) for t in terms}, frozenset(slots or ()))
            found.append([{"start_pos": s, "end_pos": e, "kind": kind} for s, e, kind in sorted(spans)])
        clean = [None if t is None else sanitized(t, [(x["start_pos"], x["end_pos"], x["kind"]) for x in f]) for t, f in zip(batch.column(2).to_pylist(), found)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(_SPAN)), pa.array(clean, pa.string())], names=["rec_table", "rec_id", "items", "sanitized"])


def person_slots(seen: DataFrame) -> DataFrame:
    """``(context, share)``: contexts whose runs are mostly listed names, and different ones.

    The number of different names keeps out the ordinary places of a listed name that is also
    a word: they are seen with that one name only.
    """
    runs = seen.select(F.explode("runs").alias("r"))
    # the name that touches the context: its first word behind, its last word before
    sides = F.array(*[F.struct(F.col(f"r.{side}").alias("context"), F.element_at("r.words", at).alias("word")) for side, at in (("left", 1), ("right", -1))])
    each = runs.select(F.explode(sides).alias("s"), F.col("r.listed").alias("listed")).select("s.context", F.col("listed").cast("int").alias("k"), F.when(F.col("listed"), F.col("s.word")).alias("name"))
    stats = each.groupBy("context", "name").agg(F.count("*").alias("n"), F.sum("k").alias("k")).groupBy("context").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("name").alias("kinds"))
    telling = F.substring("context", 3, 100).rlike(r"[<\p{L}]")  # the start of a sentence or a comma alone tells nothing
    return stats.where(telling & (F.col("kinds") >= KINDS_IN_SLOT) & (F.col("k") >= SLOT * F.col("n"))).select("context", (F.col("k") / F.col("n")).alias("share"))


def disclosing_terms(seen: DataFrame, slots: DataFrame, listed: DataFrame) -> DataFrame:
    """``(term, share, part)``: terms whose smoothed share of person slots is over the threshold, and listed names.

    ``share`` is the probability of a person slot given the term, shrunk to the corpus-wide
    rate r by ``PRIOR`` occurrences; log2(share / r) is the term's pointwise mutual
    information with the slots, and a fixed share is a fixed threshold on it.
    """
    runs = seen.select(F.explode("runs").alias("r")).select("r.left", "r.right", "r.words", "r.titled")
    of_left, of_right = slots.select(F.col("context").alias("left"), F.lit(1).alias("in_left")), slots.select(F.col("context").alias("right"), F.lit(1).alias("in_right"))
    filled = runs.join(of_left, "left", "left").join(of_right, "right", "left").where("titled or in_left = 1 or in_right = 1")
    in_slot = filled.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("k"))
    total = seen.select(F.explode("terms").alias("t")).groupBy("t.term").agg(F.sum("t.n").alias("n"))
    stats = total.join(in_slot, "term", "left").select("term", "n", F.coalesce("k", F.lit(0)).alias("k"))
    rate = stats.agg((F.sum("k") / F.sum("n")).alias("rate"))
    share = (F.col("k") + PRIOR * F.coalesce("rate", F.lit(0.0))) / (F.col("n") + PRIOR)
    scored = stats.join(F.broadcast(rate)).select("term", "n", "k", share.alias("share"))
    return scored.join(listed, "term", "left").where(F.col("part").isNotNull() | ((F.col("share") >= DISCLOSURE) & (F.col("k") >= 2))).select("term", "share", "part")


#: Rows up to which a side is broadcast (some 20 MB); beyond, the join shuffles.
SMALL = 200_000


def _if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def find_items(texts: DataFrame, hints: DataFrame) -> DataFrame:
    """``(rec_table, rec_id, items, sanitized)``, one row per text.

    ``texts`` has ``rec_table string, rec_id long, text string``; ``hints`` has ``name,
    name_part`` (a small list by definition). ``items`` lists ``start_pos`` and ``end_pos``
    (0-based code points) and ``kind``. A null text has null results. Statistics are over all
    texts given; an unlisted name needs to be seen twice in a person slot, and a slot with
    three different listed names. Each text is searched for items with a form once. Where a
    record key repeats, each row is searched.
    """
    listed = hints.where("name is not null").select(F.lower("name").alias("name"), "name_part").withColumn("term", F.explode(F.split("name", "-"))).groupBy("term").agg(F.min("name_part").alias("part"))
    known = frozenset(r["term"] for r in listed.select("term").collect())
    src = texts.select(F.struct(F.col("rec_id").cast("bigint").alias("rec_id"), F.expr("uuid()").alias("u")).alias("row"), "rec_table", "text")
    seen = materialize(src.mapInArrow(_evidence(known), f"row struct<rec_id: bigint, u: string>, rec_table string, {_EVIDENCE}"), "terms")
    slots = materialize(person_slots(seen), "slots")
    terms = materialize(disclosing_terms(seen, _if_small(slots), listed), "terms")
    has = seen.select("row", F.explode("terms.term").alias("term")).join(_if_small(terms), "term").groupBy("row").agg(F.collect_set(F.struct("term", "share", "part")).alias("terms"))
    at = seen.select("row", F.explode("asked").alias("context")).join(_if_small(slots), "context").groupBy("row").agg(F.collect_set("context").alias("slots"))
    rows = seen.select("row", "rec_table", "text", "spans").join(has, "row", "left").join(at, "row", "left")
    return rows.select("rec_table", "row.rec_id", "text", "spans", "terms", "slots").mapInArrow(_items, f"rec_table string, rec_id bigint, items {_SPANS}, sanitized string")
