"""Personal information inside free text (problem 3).

Whole texts are scored by the network of pii_tagger.py in windows of WINDOW characters that
overlap by OVERLAP; where two overlap, a character takes the scores of the window in which it stands
farther from the border.  The best tags are those of the whole text: of the parts of a longer one the
best scores between any two tags are found first, then the tags at all borders together, then
the tags between them.  Spans are then checked on their characters: an id number of 15 digits must
have the right key, an email a domain, a phone number and an address their digits, a name two
parts.  The known name parts are a feature of the network, not a condition.  The network was
trained on few email endings, so an address in plain form is also found by its form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import pii_tagger as pt
from lodestone.llm import textcodes as tc
from lodestone.session import spread

WINDOW, OVERLAP = 1_024, 96
#: Words of known names that are broadcast (16 MB); more are joined to the words of the texts.
MAX_PARTS = 1_000_000
#: Windows scored at once, and code points of texts that are held at once.
ROWS, CHARS = 320, 1 << 20
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def windows_of(begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each window: text, start, length, and the part [from, to) of it whose scores count."""
    step, size = WINDOW - OVERLAP, np.diff(begins)
    count = np.where(size > 0, np.maximum(1, -(-(size - OVERLAP) // step)), 0)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(WINDOW, size[text] - nth * step)
    lo = np.where(nth == 0, 0, OVERLAP // 2)
    hi = np.where(nth == count[text] - 1, length, WINDOW - OVERLAP // 2)
    return text, begins[:-1][text] + nth * step, length, lo, hi


def _blocks(length: np.ndarray, rows: int):
    """Numbers of windows of about one length, with the steps of the longest and which are live."""
    order = np.argsort(length, kind="stable")
    for b in range(0, len(order), rows):
        w = order[b : b + rows]
        yield w, (live := np.arange(int(length[w].max()))[:, None] < length[w])


def tag(tagger: pt.Tagger, x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Tag of each character of all texts: the best tags of each whole text."""
    text, start, length, lo, hi = windows_of(begins)
    out = np.zeros(len(x), np.int8)
    padded = np.append(x, np.zeros(WINDOW, x.dtype))
    alone = np.bincount(text, minlength=len(begins))[text] == 1

    def scores(w, live):
        return tagger.scores(np.where(live, padded[start[w] + np.arange(len(live))[:, None]], 0))

    def put(w, begin, live, tags):
        t, r = np.nonzero(live)
        out[begin[w][r] + t] = tags[t, r]

    one = np.flatnonzero(alone)
    for w, live in _blocks(length[one], ROWS):
        put(one[w], start, live, tagger.best(scores(one[w], live), live))
    parts = np.flatnonzero(~alone)
    if len(parts):
        begin, size = start + lo, hi - lo
        where = np.cumsum(size[parts]) - size[parts]
        joint = np.empty((int(size[parts].sum()), pt.TAGS), np.float32)
        for w, live in _blocks(length[parts], ROWS):
            e, p = scores(parts[w], live), parts[w]
            for r in range(len(p)):
                joint[where[w[r]] : where[w[r]] + size[p[r]]] = e[lo[p[r]] : hi[p[r]], :, r]
        joint = np.concatenate([joint, np.zeros((WINDOW, pt.TAGS), np.float32)])
        cores = lambda w, live: np.ascontiguousarray(joint[where[w] + np.arange(len(live))[:, None]].transpose(0, 2, 1))
        between = np.empty((len(parts), pt.TAGS + 1, pt.TAGS), np.float32)
        for w, live in _blocks(size[parts], ROWS // 8):
            between[w] = tagger.transfers(cores(w, live), live)
        before, last = _borders(between, text[parts])
        for w, live in _blocks(size[parts], ROWS):
            put(parts[w], begin, live, tagger.best(cores(w, live), live, before[w], last[w]))
    return out


def _borders(between: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag before each part (-1 at the beginning of a text) and at its end, on the best path of its text."""
    before, last = np.full(len(text), -1), np.zeros(len(text), np.int64)
    ends = np.r_[np.flatnonzero(np.r_[True, text[1:] != text[:-1]]), len(text)]
    for a, z in zip(ends[:-1], ends[1:]):
        best, back = between[a, -1], []
        for k in range(a + 1, z):
            paths = best[:, None] + between[k, :-1]
            back.append(paths.argmax(0))
            best = paths.max(0)
        at = int(best.argmax())
        for k in range(z - 1, a, -1):
            last[k] = at
            at = before[k] = int(back[k - 1 - a][at])
        last[a] = at
    return before, last


def spans_of(tags: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of the tagged spans.  A span ends with its kind, at a new beginning or
    at the end of its text; one that lacks its beginning is taken to begin where it is seen."""
    kind = (tags.astype(np.int64) - 1) // 2
    edge = np.zeros(len(tags) + 1, bool)
    edge[begins] = True
    before = np.append(-1, kind[:-1]) if len(kind) else kind
    first = (tags > 0) & (((tags % 2) == 1) | (kind != before) | edge[:-1])
    start = np.flatnonzero(first)
    goes_on = np.append((tags > 0) & ~first, False)
    stop = np.flatnonzero(~goes_on)
    end = stop[np.searchsorted(stop, start + 1)]
    return start, end, kind[start]


#: Titles, which are no part of a name.
_TITLE = re.compile(r"(?:mr|mrs|ms|mme|mlle|monsieur|madame|herr|frau|dr|prof)\b\.?\s+", re.I)
_AT = re.compile(r"@|\bat\b|[\[({]at[\])}]", re.I)
#: A whole address with any ending of letters; no part of a path, a package or "user@host:path".
_EMAIL = re.compile(r"(?<![\w.+%/@-])[\w+%-]+(?:\.[\w+%-]+)*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w@/-]|[.:]\w)")
_PATH = re.compile(r"@.*[:/]\w")
#: What names a passport.
_PASSPORT = re.compile(r"passport|passeport|pasaporte|passaporto|paspoort|reisepass|ausweis", re.I)
_DOT = re.compile(r"\.|\bdot\b", re.I)


def checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The span without outer blanks and punctuation, or None if its characters can't be of the kind."""
    head = "+(" if kind == "phone" else "#" if kind == "address" else ""
    while start < end and not (text[start].isalnum() or text[start] in head):
        start += 1
    while end > start and not (text[end - 1].isalnum() or (text[end - 1] == "." and kind in ("address", "name"))):
        end -= 1
    while kind == "name" and (title := _TITLE.match(text, start, end)):
        start = title.end()
    v = text[start:end]
    digits = re.sub(r"\D", "", v)
    if kind == "email":
        ok = bool(_AT.search(v) and _DOT.search(v[_AT.search(v).end() :])) and "/" not in v and not _PATH.search(text, start, min(len(text), end + 2))
    elif kind == "phone":
        ok = 8 <= len(digits) <= 15
    elif kind == "id_number":
        if re.search(r"[^\W\d_]", v):  # with letters, a passport's, which is named as such
            ok = 5 <= len(digits) <= 9 and bool(_PASSPORT.search(text, max(0, start - 40), start))
        else:
            ok = len(digits) == 9 or (len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:]))
    elif kind == "address":
        ok = bool(digits) and bool(re.search(r"[^\W\d_]{3}", v)) and bool(re.search(r"\w\W+\w", v))
    else:
        ok = len(re.findall(r"[^\W\d_]+", v)) >= 2 and not digits
    return (start, end) if ok else None


def with_plain_emails(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans with each address in plain form, which takes the place of parts of it tagged as email."""
    for m in _EMAIL.finditer(text):
        over = [x for x in spans if x[0] < m.end() and m.start() < x[1]]
        if all(k == "email" and m.start() <= s and e <= m.end() for s, e, k in over):
            spans = sorted([x for x in spans if x not in over] + [(*m.span(), "email")])
    return spans


def find_batch(texts: pa.Array, given: np.ndarray, family: np.ndarray, tagger: pt.Tagger) -> list[list[tuple[int, int, str]]]:
    """Checked spans of each text, in order."""
    codes, begins = tc.codes_of(texts)
    x = pt.inputs(codes, begins, given, family)
    start, end, kind = spans_of(tag(tagger, x, begins), begins)
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(begins) - 1)]
    of = np.searchsorted(begins, start, "right") - 1
    have: dict[int, str] = {}
    for s, e, k, i in zip(start.tolist(), end.tolist(), kind.tolist(), of.tolist()):
        if i not in have:
            have = {i: texts[i].as_py()}
        ok = checked(have[i], s - int(begins[i]), e - int(begins[i]), pt.KINDS[k])
        if ok and (not out[i] or ok[0] >= out[i][-1][1]):
            out[i].append((*ok, pt.KINDS[k]))
    for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, "@"), False).to_numpy(zero_copy_only=False)).tolist():
        out[i] = with_plain_emails(texts[i].as_py(), out[i])
    return out


def _name_words(parts: DataFrame) -> DataFrame:
    """(k, h): hashes of the words of known name parts, k 0 for given and 1 for family names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, kind in enumerate(("given", "family")):
                h = pt.name_hashes(batch.column(0).filter(pc.equal(batch.column(1), kind)).drop_null().to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k)), pa.array(h.view(np.int64))], names=["k", "h"])

    return parts.select("name_part", "position_kind").mapInArrow(run, "k bigint, h bigint").distinct()


def _with_known(source: DataFrame, words: DataFrame) -> DataFrame:
    """source (id, t) with the known words that each text holds, as array of (k, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, of = pt.word_hashes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(h.view(np.int64))], names=["x", "h"])

    keyed = source.withColumn("x", F.xxhash64("t"))
    held = keyed.select("x", "t").where("t is not null").mapInArrow(run, "x bigint, h bigint").distinct()
    of = held.join(words, "h").groupBy("x").agg(F.collect_list(F.struct("k", "h")).alias("w"))  # no more than a text has words
    return keyed.join(of, "x", "left").select("id", "t", "w")


def _run(df: DataFrame, parts: DataFrame, id_col: str, text_col: str, schema: str, make, most: int = MAX_PARTS) -> DataFrame:
    spark = df.sparkSession
    source, words = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")), _name_words(parts)
    known = words.limit(most + 1).toArrow()
    if len(known) > most:  # too many to send to every task
        source, known = _with_known(source, words), None
    else:
        k, h = known["k"].to_numpy(), known["h"].to_numpy().view(np.uint64)
        known = np.sort(h[k == 0]), np.sort(h[k == 1])
    shared = spark.sparkContext.broadcast((known, pt.weights()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        tagger = pt.Tagger(weights)
        for batch in batches:
            _, begins = tc.codes_of(batch.column(1))
            for a, z in tc.chunks(begins, CHARS):
                part = batch.slice(a, z - a)
                if known is None:
                    flat = part.column(2).flatten()
                    k, h = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False).view(np.uint64)
                    given, family = np.unique(h[k == 0]), np.unique(h[k == 1])
                else:
                    given, family = known
                yield make(part.column(0), part.column(1), find_batch(part.column(1), given, family, tagger))

    return spread(source).mapInArrow(run, schema)


def find(df: DataFrame, parts: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, kind, start_pos, end_pos) of each mention of personal information.

    Positions are code points from 0.  Null and empty texts have no mention; a row with a null id
    reports null; rows delivered twice with one id report once; other columns are not read; an
    empty table gives no rows.  ``parts`` are known name parts (name_part, position_kind), which
    may be empty.
    """

    def make(ids, _, spans):
        flat = [(i, k, s, e) for i, found in zip(ids.to_pylist(), spans) for s, e, k in found]
        i, k, s, e = zip(*flat) if flat else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.string()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["id", "kind", "s", "e"])

    return _run(df, parts, id_col, text_col, "id bigint, kind string, s bigint, e bigint", make).distinct().toDF("id", "kind", "start_pos", "end_pos")


def redact(df: DataFrame, parts: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, text) of each row with every mention replaced by its kind's placeholder and all else
    unchanged.  Null texts stay null; repeated rows stay repeated."""

    def make(ids, texts, spans):
        out = []
        for text, found in zip(texts.to_pylist(), spans):
            if text and found:
                pieces, at = [], 0
                for s, e, k in found:
                    pieces += [text[at:s], PLACEHOLDERS[k]]
                    at = e
                text = "".join(pieces) + text[at:]
            out.append(text)
        return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], names=["id", "text"])

    return _run(df, parts, id_col, text_col, "id bigint, text string", make).toDF(id_col, text_col)
