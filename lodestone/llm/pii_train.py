"""Trains the tagger of pii_tagger.py: python -m lodestone.llm.pii_train DIR MINUTES [go_on].

Labelled spans come from labelling functions run over the memories of one directory and the
directory's name_parts; each labelled value is then often replaced by one drawn at random with
the same shape, so that the network learns shapes and surroundings and not the values.  The
number of texts is bounded by MAX_TEXTS.  Nothing here runs in a query.
"""

from __future__ import annotations

import random
import re
import sys
import time

import numpy as np

from lodestone.llm import pii_tagger as pt

MAX_TEXTS = 20_000
HIDDEN, CROP, BATCH = 32, 144, 96
SP = r"[\s ]"
W = r"[^\W\d_]"


def _rx(p: str) -> re.Pattern:
    return re.compile(p, re.I)


TLD = r"(?:example|test|invalid|com|org|net|fr|de|uk)"
EMAIL = _rx(
    rf"(?:[\w+-]+(?:(?:\.|{SP}dot{SP}|{SP}?[\[(]dot[\])]{SP}?)[\w+-]+)*)"
    rf"(?:{SP}?@{SP}?|{SP}at{SP}|{SP}?[\[(]at[\])]{SP}?)"
    rf"[\w-]+(?:(?:\.|{SP}dot{SP}|{SP}?[\[(]dot[\])]{SP}?)[\w-]+)*(?:\.|{SP}dot{SP}|{SP}?[\[(]dot[\])]{SP}?){TLD}\b"
)
PHONE = _rx(
    rf"(?<![\w+])(?:\+?1[\s.-]?)?(?:\(\d{{3}}\)|\d{{3}})[\s.-]?555[\s.-]?\d{{4}}(?!\d)"
    rf"|\+1\d{{3}}555\d{{4}}"
    rf"|(?:(?:\+|00)33[\s.-]?(?:\(0\))?[\s.-]?[1-9]|(?<![\d.\w-])0[1-9])(?:[\s.-]?\d{{2}}){{4}}(?!\d)"
    rf"|(?:(?:\+|00)49[\s./-]?(?:\(0\))?[\s.-]?30|(?<![\d.-])\(?030\)?)[\s./-]?23125[\s.-]?\d{{3}}(?!\d)"
    rf"|(?:(?:\+|00)44[\s.-]?(?:\(0\))?[\s.-]?20|(?<![\d.-])\(?020\)?)[\s.-]?7946[\s.-]?\d{{4}}(?!\d)"
)
US_ID = re.compile(r"(?<![\w-])\d{3}[-‑ ]\d{2}[-‑ ]\d{4}(?![\w-])")
FR_ID = re.compile(r"(?<![\d-])[12](?:[\s ]?\d){12}[\s ]?\d{2}(?!\d)")
PASSPORT = _rx(r"(?:passport|passeport|reisepass)[^\d\n]{0,14}?(\d{2}\s?[a-z]{2}\s?\d{5})(?!\w)")
TOWN = rf"(?:,{SP}\d{{5}}{SP}{W}+(?:-{W}+)?)?"
ADDRESS = _rx(
    rf"\b\d{{1,3}}(?:-\d{{1,3}}|[a-d])?{SP}{W}+{SP}(?:street|st|road|rd|lane|ln|avenue|ave|close|terrace|drive|way|row|crescent)\b\.?(?!{SP}view)"
    rf"(?:,?{SP}(?:flat|apt|unit|#){SP}?\d+)?{TOWN}"
    rf"|\b\d{{1,3}}(?:{SP}(?:bis|ter|quater))?,?{SP}(?:rue|avenue|av\.|bd|boulevard|allée|impasse|chemin|place|quai|cours){SP}(?:(?:de{SP}la|des|du|de){SP}|de{SP}l['’])?{W}+(?:{SP}(?:gris|vermeil|bas|puits|haut|noyers|vert|noir|bleu|rouge|blanc|{W}+s))?{TOWN}"
    rf"|\b{W}+(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer){SP}\d{{1,3}}[a-d]?\b{TOWN}"
)
FAMILY_END = r"(?:v[oö]k|zz[aâä]n|ss[iï][eéë]r|q[uü][eéë]t|rw[iï]ck|mbr[yý]|ld[eéë]n|st[oö]v|[aeiouöüéâïëä]ndt|[aeiouöüéâïëä]nsk)"
FAMILY = rf"(?:O['’])?{W}{{2,}}{FAMILY_END}(?:-{W}{{3,}})?"
PARTICLE = rf"(?:(?:de|du|da|di|van|von){SP})?"


def fr_key(digits: str) -> bool:
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


class Labeller:
    def __init__(self, texts: list[str], parts: list[tuple[str, str]]):
        fold = lambda s: "".join(map(chr, pt.folded(np.array([ord(c) for c in s], np.uint32)))) if s else ""
        self.fold = fold
        self.given = {fold(p) for p, k in parts if k == "given"}
        self.family = {fold(p) for p, k in parts if k == "family"}
        seen: dict[str, int] = {}
        for t in texts:
            for w in set(re.findall(rf"{W}+", t)):
                if w.islower():
                    seen[fold(w)] = seen.get(fold(w), 0) + 1
        self.common = {w for w, n in seen.items() if n > len(texts) / 700} - self.given
        self.common |= {"call", "per", "copied", "mit", "avec", "is", "for", "de", "and", "the", "update", "rappel", "termin", "while", "owner", "asked", "form", "nouvelle", "todo", "fyi", "note", "left"}
        self.common |= {"mr", "mrs", "ms", "mme", "mlle", "monsieur", "madame", "herr", "frau", "dr", "prof", "me"}
        lead = rf"({W}{{2,}}|{W}\.?)"
        self.ordered = _rx(rf"(?<![\w'’@.-]){lead}{SP}(?:{W}\.?{SP})?{PARTICLE}({FAMILY})(?![\w-])")
        self.turned = _rx(rf"(?<![\w'’@.-])({FAMILY})(,{SP}|{SP})({W}{{3,}}|{W}\.)(?![\w'’-])")

    def names(self, t: str) -> list[tuple[int, int]]:
        out = []
        at = 0
        while m := self.ordered.search(t, at):
            first = self.fold(m[1])
            if m[1].rstrip(".").lower() in ("m", "d") and m[1].endswith(".") and self.fold(t[m.end() :].strip()[:12].split(" ")[0]) in self.given:
                at = m.end(1)  # "M. Family Given": a title
                continue
            ok = (len(first.rstrip(".")) == 1 and (m[1].endswith(".") or m[1].isupper())) or (first in self.given) or (first not in self.common and first[:1].isalpha() and not re.fullmatch(FAMILY, m[1], re.I) and (m[1][0].isupper() or m[0].islower() and first not in self.common) and len(first) > 3)
            if ok:
                out.append(m.span())
                at = m.end()
            else:
                at = m.end(1)
        for m in self.turned.finditer(t):
            second = self.fold(m[3])
            capital = m[1][0].isupper() and m[3][0].isupper() and second not in self.common
            if (second in self.given or (capital and len(second.rstrip(".")) > 2) or (m[2].startswith(",") and second not in self.common)) and not any(a < m.end() and m.start() < b for a, b in out):
                out.append(m.span())
        return out

    def __call__(self, t: str) -> list[tuple[int, int, int]]:
        spans = [(*m.span(), 0) for m in EMAIL.finditer(t) if "/" not in t[max(0, m.start() - 1) : m.end()]]
        spans += [(*m.span(), 1) for m in PHONE.finditer(t)]
        spans += [(*m.span(), 2) for m in US_ID.finditer(t)]
        spans += [(*m.span(), 2) for m in FR_ID.finditer(t) if fr_key(re.sub(r"\D", "", m[0]))]
        spans += [(*m.span(1), 2) for m in PASSPORT.finditer(t)]
        spans += [(*m.span(), 3) for m in ADDRESS.finditer(t) if not re.search(r"^\d+ (?:no|street|lanes|roads)\b", m[0], re.I)]
        spans += [(a, b, 4) for a, b in self.names(t)]
        spans.sort()
        out: list[tuple[int, int, int]] = []
        for s in spans:
            if not out or s[0] >= out[-1][1]:
                out.append(s)
        return out


CONSONANTS, VOWELS = "bcdfghjklmnpqrstvwxyz", "aeiou" * 4 + "yéöüàï"
ENDINGS = ("", "", "n", "rk", "lle", "ne", "th", "d", "s", "ra", "l", "son", "mann", "ez", "berg", "ton", "ski", "ova", "ini", "ard", "eau", "ier", "ich", "sen", "ley", "ia", "o", "us", "et")
DOMAINS = ("com", "org", "net", "info", "eu", "io", "edu", "gov", "fr", "de", "uk", "co.uk", "ch", "at", "be", "it", "es", "nl", "pl", "se", "ca", "com.au", "museum", "cloud", "dev", "app")


def _word(rng: random.Random) -> str:
    """A word that looks like a name in one language or another."""
    return "".join(rng.choice(CONSONANTS) + rng.choice(VOWELS) for _ in range(rng.choice((1, 2, 2, 3)))) + rng.choice(ENDINGS)


def _like(rng: random.Random, shown: str) -> str:
    """A new word in the case of the one shown."""
    w = _word(rng)
    return w.upper() if shown.isupper() and len(shown) > 1 else w.capitalize() if shown[0].isupper() else w


def _ascii(w: str) -> str:
    return "".join(map(chr, pt.folded(np.array([ord(c) for c in w], np.uint32)))) if not w.isascii() else w


def _digits(rng: random.Random, shape: str) -> str:
    """The shape with a digit for each N (none of them zero for X) and a capital for each A."""
    draw = {"N": "0123456789", "X": "123456789", "A": "ABCDEFGHJKLMNPRSTUVWXYZ"}
    return "".join(rng.choice(draw[c]) if c in draw else c for c in shape)


PHONES = (
    "(XNN) XNN-NNNN", "XNN-XNN-NNNN", "XNN.XNN.NNNN", "XNN XNN NNNN", "+1 XNN XNN NNNN", "+1-XNN-XNN-NNNN", "+1 (XNN) XNN-NNNN", "1-XNN-XNN-NNNN", "+1XNNXNNNNNN",
    "0X NN NN NN NN", "0X.NN.NN.NN.NN", "0X-NN-NN-NN-NN", "0XNNNNNNNN", "+33 X NN NN NN NN", "+33XNNNNNNNN", "+33 (0)X NN NN NN NN", "0033 X NN NN NN NN", "+33.X.NN.NN.NN.NN",
    "+49 XN NNNNNNN", "+49 XNN NNNNNN", "+49 (0)XN NNNNNNNN", "0XN NNNNNNN", "0XN/NNNNNNN", "0XNN NNNN NNN", "(0XN) NNNN NNNN", "0XNNN-NNNNNN", "+49XNNNNNNNNN", "0049 XNN NNNNNNN",
    "+44 XN NNNN NNNN", "+44 XNNN NNNNNN", "0XN NNNN NNNN", "0XNNN NNNNNN", "(0XNNN) NNNNNN", "+44 (0)XN NNNN NNNN", "07NNN NNNNNN", "07NNN NNN NNN",
    "+XN NN NNN NN NN", "+XNN XNN NNN NNN", "+XN XNN NNN NNN", "00XN NNN NNN NNN",
)
PASSPORTS = ("NNAANNNNN", "ANNNNNNNN", "AANNNNNN", "AANNNNNNN", "XNNNNNNNN", "ANNANNNNN", "NNAA NNNNN")


def new_value(kind: int, v: str, rng: random.Random) -> str:
    """Another value of the kind, in one of many forms; obfuscation and order of ``v`` are kept."""
    if kind == 0:
        words = list(re.finditer(rf"{W}+", v))
        out, at = [], 0
        for m in words:
            out.append(v[at : m.start()])
            keep = m[0].lower() in ("at", "dot")
            out.append(m[0] if keep else rng.choice(DOMAINS) if m is words[-1] and "." in v[m.start() - 1 : m.start()] else rng.choice([d for d in DOMAINS if "." not in d]) if m is words[-1] else _ascii(_like(rng, m[0])) if len(m[0]) > 2 else m[0])
            at = m.end()
        return "".join(out) + v[at:]
    if kind == 1:
        return _digits(rng, rng.choice(PHONES))
    if kind == 2:
        if re.search(r"[A-Za-z]", v):
            made = _digits(rng, rng.choice(PASSPORTS))
            return made.lower() if v.islower() else made
        if len(re.sub(r"\D", "", v)) != 15:
            return _digits(rng, rng.choice(("NNN-NN-NNNN", "NNN NN NNNN", "NNN-NN-NNNN")))
        d = rng.choice("12") + _digits(rng, "NNNNNNNNNNNN")
        d += f"{97 - int(d) % 97:02d}"
        return d if rng.random() < 0.4 else " ".join((d[0], d[1:3], d[3:5], d[5:7], d[7:10], d[10:13], d[13:]))
    if kind == 3:  # new numbers, and new names of the street and the town
        fixed = set("street st road rd lane ln avenue ave close terrace drive way row crescent flat apt unit bis ter quater rue av bd boulevard allée impasse chemin place quai cours des du de la".split())
        kinds = r"(?:straße|strasse|str|gasse|weg|allee|platz|ufer)$"

        def word(m: re.Match) -> str:
            if m[0].lower() in fixed or len(m[0]) < 3:
                return m[0]
            tail = re.search(kinds, m[0].lower())
            return _like(rng, m[0]) + (m[0][tail.start() :] if tail else "") if not tail or tail.start() else m[0]

        v = re.sub(rf"{W}+", word, v)
        return re.sub(r"\d+", lambda m: _digits(rng, "X" + "N" * (len(m[0]) - 1)) if len(m[0]) == 5 else str(rng.randrange(1, rng.choice((10, 100, 400)))), v)
    # without capitals nothing but a known or a telling part shows that it is a name: one part stays
    words = [m.span() for m in re.finditer(rf"{W}{{3,}}", v)]
    kept = rng.choice(words) if words and rng.random() < (0.9 if v.islower() or v.isupper() else 0.6) else None
    return re.sub(rf"{W}{{3,}}", lambda m: m[0] if m[0].lower() in ("von", "van") or m.span() == kept or rng.random() < 0.3 else _like(rng, m[0]), v)


def recased(text: str, upper: bool) -> str:
    """The text in capitals or without, character for character."""
    return "".join(c if len(x := c.upper() if upper else c.lower()) != 1 else x for c in text)


def varied(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with most labelled values, and some digits elsewhere, drawn anew."""
    out, now, last = [], [], 0
    for a, b, kind in [*spans, (len(text), len(text), -1)]:
        rest = text[last:a]
        if rng.random() < 0.3:
            rest = re.sub(r"\d", lambda m: str(rng.randrange(10)), rest)
        out.append(rest)
        if kind < 0:
            break
        v = text[a:b] if rng.random() < 0.3 else new_value(kind, text[a:b], rng)
        begin = sum(map(len, out))
        out.append(v)
        now.append((begin, begin + len(v), kind))
        last = b
    return "".join(out), now


def elsewhere(values: list[tuple[str, int]], fragments: list[str], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """New values between words cut from texts without any, so that no sentence goes with a kind."""
    out, spans, at = [], [], 0
    for _ in range(rng.choice((1, 2, 3))):
        v, kind = rng.choice(values)
        lead = rng.choice(fragments) + rng.choice((" ", " ", ": ", " (", ", "))
        if kind == 2 and re.search(r"[A-Za-z]", v):
            lead += rng.choice(("passport ", "passport no. ", "passeport ", "Reisepass ", "Passport number: "))
        v = new_value(kind, v, rng)
        out += [lead, v, rng.choice((". ", ", ", " ", ") ", "\n"))]
        at += len(lead)
        spans.append((at, at + len(v), kind))
        at += len(v) + len(out[-1])
    return "".join(out), spans


#: Forms that look like personal information: what stands in one outside the labels is shown often.
LURE = re.compile(rf"@|\d{{2,}}[ .:-]?\d+|\d+ [A-Z]{W}+|[A-Z]{W}+ [A-Z]{W}+|[A-Z]\. {W}+")


def crops(texts: list[str], label: Labeller, parts, seed: int):
    """Endless batches (inputs, tags), (CROP, BATCH) each."""
    import pyarrow as pa

    from lodestone.llm import textcodes as tc

    rng = random.Random(seed)
    labelled = [(t, label(t)) for t in texts]
    with_pii = [i for i, (_, s) in enumerate(labelled) if s]
    values = [(t[a:b], k) for t, s in labelled for a, b, k in s]
    values = [v for kind in range(len(pt.KINDS)) for v in rng.choices([x for x in values if x[1] == kind] or values[:1], k=3_000)] if values else []
    lures = [i for i, (t, s) in enumerate(labelled) if any(not any(a < m.end() and m.start() < b for a, b, _ in s) for m in LURE.finditer(t))]
    plain = [t for t, s in labelled if not s and len(t) > 120]
    fragments = []
    for _ in range(8_000):
        words = rng.choice(plain).split()
        k = rng.randrange(max(1, len(words) - 8))
        fragments.append(" ".join(words[k : k + rng.randrange(1, 9)]))
    known = {w for w in label.given | label.family}
    fragments = [f for f in fragments if not any(label.fold(w) in known or w[:1].isupper() for w in f.split()[-2:])]
    given, family = [p for p, k in parts if k == "given"], [p for p, k in parts if k == "family"]
    while True:
        keep = rng.choice((0.4, 0.7, 0.95))
        g = pt.name_hashes([p for p in given if rng.random() < keep])
        f = pt.name_hashes([p for p in family if rng.random() < keep])
        some, tags = [], []
        for _ in range(BATCH):
            kind = rng.random()
            i = rng.choice(with_pii) if kind < 0.5 else rng.choice(lures) if kind < 0.75 else rng.randrange(len(labelled))
            t, s = elsewhere(values, fragments, rng) if kind >= 0.88 else varied(*labelled[i], rng) if rng.random() < 0.7 else labelled[i]
            if s and kind < 0.5:
                a = s[rng.randrange(len(s))][0] - rng.randrange(CROP - 30)
            elif 0.5 <= kind < 0.75 and (m := [x.start() for x in LURE.finditer(t) if not any(a <= x.start() < b for a, b, _ in s)]):
                a = rng.choice(m) - rng.randrange(CROP - 30)
            elif kind >= 0.88:
                a = rng.randrange(max(1, len(t) - CROP + 1))
            else:
                a = rng.randrange(max(1, len(t) - CROP // 2))
            a = max(0, a)
            piece = t[a : a + CROP]
            if (case := rng.random()) < 0.12:
                piece = recased(piece, case < 0.08)
            y = np.zeros(CROP, np.int64)
            for x, z, k in s:
                if z <= a or x >= a + CROP:
                    continue
                y[max(0, x - a) : z - a] = 2 + 2 * k
                y[max(0, x - a)] = 1 + 2 * k  # a crop may begin inside one
            some.append(piece)
            tags.append(y)
        codes, begins = tc.codes_of(pa.array(some, pa.string()))
        flat = pt.inputs(codes, begins, g, f)
        x = np.zeros((CROP, BATCH), np.int64)
        for j in range(BATCH):
            x[: begins[j + 1] - begins[j], j] = flat[begins[j] : begins[j + 1]]
        yield x, np.stack(tags, 1)


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in (0, 1):
        p[f"char{d}"] = rng.normal(0, 0.15, (pt.SYMBOLS, 4 * HIDDEN))
        p[f"char{d}"][:, HIDDEN : 2 * HIDDEN] += 0.5
        p[f"flag{d}"] = rng.normal(0, 0.15, (pt.FLAGS, 4 * HIDDEN))
        p[f"rec{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        p[f"out{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, pt.TAGS))
    p["bias"], p["start"], p["trans"] = np.zeros(pt.TAGS), np.zeros(pt.TAGS), np.zeros((pt.TAGS, pt.TAGS))
    for k in range(len(pt.KINDS)):  # going on needs a beginning
        p["start"][2 + 2 * k] = -4
        p["trans"][:, 2 + 2 * k] = -4
        p["trans"][1 + 2 * k : 3 + 2 * k, 2 + 2 * k] = 1
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def step(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log likelihood per character and its gradients."""
    T, B = x.shape
    H = HIDDEN
    live = x != 0
    sym, bits = x // 16, ((x[..., None] % 16) >> np.arange(pt.FLAGS) & 1).astype(np.float32)
    states, e = [], np.zeros((T, B, pt.TAGS), np.float32) + p["bias"]
    for d in (0, 1):
        U = p[f"rec{d}"]
        pre = p[f"char{d}"][sym] + bits @ p[f"flag{d}"]
        hs, cs = np.zeros((T + 1, B, H), np.float32), np.zeros((T + 1, B, H), np.float32)
        gates = np.zeros((T, B, 4 * H), np.float32)
        order = range(T) if d == 0 else range(T - 1, -1, -1)
        h, c = hs[0], cs[0]
        for n, t in enumerate(order):
            z = pre[t] + h @ U
            a = gates[t]
            a[:, : 3 * H] = pt._sigmoid(z[:, : 3 * H])
            a[:, 3 * H :] = np.tanh(z[:, 3 * H :])
            c = a[:, H : 2 * H] * c + a[:, :H] * a[:, 3 * H :]
            h = a[:, 2 * H : 3 * H] * np.tanh(c)
            if d:
                h, c = h * live[t][:, None], c * live[t][:, None]
            hs[n + 1], cs[n + 1] = h, c
            e[t] += h @ p[f"out{d}"]
        states.append((hs, cs, gates, order))
    # CRF
    trans, start = p["trans"], p["start"]
    alpha = np.zeros((T, B, pt.TAGS), np.float32)
    alpha[0] = start + e[0]
    for t in range(1, T):
        nxt = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        alpha[t] = np.where(live[t][:, None], nxt, alpha[t - 1])
    logz = _lse(alpha[-1], 1)
    beta = np.zeros((T, B, pt.TAGS), np.float32)
    dtrans = np.zeros_like(trans)
    for t in range(T - 1, 0, -1):
        right = e[t] + beta[t]
        on = live[t]
        pair = np.exp(alpha[t - 1][:, :, None] + trans + right[:, None, :] - logz[:, None, None]) * on[:, None, None]
        dtrans += pair.sum(0)
        beta[t - 1] = np.where(on[:, None], _lse(trans + right[:, None, :], 2), beta[t])
    marg = np.exp(alpha + beta - logz[:, None]) * live[..., None]
    rows = np.arange(B)
    gold = start[y[0]] + e[0][rows, y[0]]
    for t in range(1, T):
        gold = gold + np.where(live[t], trans[y[t - 1], y[t]] + e[t][rows, y[t]], 0)
        np.add.at(dtrans, (y[t - 1][live[t]], y[t][live[t]]), -1)
    n = live.sum()
    de = marg
    np.put_along_axis(de, y[..., None], np.take_along_axis(de, y[..., None], 2) - live[..., None], 2)
    de = (de / n).astype(np.float32)
    grads = {"bias": de.sum((0, 1)), "start": de[0].sum(0), "trans": dtrans / n}
    onehot = None
    for d in (0, 1):
        hs, cs, gates, order = states[d]
        U, V = p[f"rec{d}"], p[f"out{d}"]
        dz = np.zeros((T, B, 4 * H), np.float32)
        dh, dc = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
        dV, dU = np.zeros_like(V), np.zeros_like(U)
        for k, t in reversed(list(enumerate(order))):
            dh = dh + de[t] @ V.T
            dV += hs[k + 1].T @ de[t]
            if d:
                dh, dc = dh * live[t][:, None], dc * live[t][:, None]
            a, tc_ = gates[t], np.tanh(cs[k + 1])
            i, f, o, g = a[:, :H], a[:, H : 2 * H], a[:, 2 * H : 3 * H], a[:, 3 * H :]
            dct = dc + dh * o * (1 - tc_ * tc_)
            z = dz[t]
            z[:, :H] = dct * g * i * (1 - i)
            z[:, H : 2 * H] = dct * cs[k] * f * (1 - f)
            z[:, 2 * H : 3 * H] = dh * tc_ * o * (1 - o)
            z[:, 3 * H :] = dct * i * (1 - g * g)
            dU += hs[k].T @ z
            dh, dc = z @ U.T, dct * f
        flat = dz.reshape(T * B, -1)
        if onehot is None:
            onehot = np.zeros((T * B, pt.SYMBOLS), np.float32)
            onehot[np.arange(T * B), sym.ravel()] = 1
        grads |= {f"char{d}": onehot.T @ flat, f"flag{d}": bits.reshape(T * B, -1).T @ flat, f"rec{d}": dU, f"out{d}": dV}
    return float((logz - gold).sum() / n), grads


_batches = None


def _begin(texts: list[str], parts, label: Labeller, seeds) -> None:
    global _batches
    _batches = crops(texts, label, parts, seeds.get())


def _one(p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    return step(p, *next(_batches))


def main(directory: str, minutes: float, go_on: bool = False, processes: int = 8, seed: int = 7) -> None:
    """Trains for so many minutes, anew or (``go_on``) from the weights there are; each step adds up the
    gradients of one batch per process."""
    import multiprocessing as mp

    import pyarrow.dataset as ds

    read = lambda t, c: ds.dataset(f"{directory}/{t}.parquet").to_table(columns=c)
    texts = list(dict.fromkeys(t for t in read("memories", ["content"])["content"].to_pylist() if t))[:MAX_TEXTS]
    parts = [(r["name_part"], r["position_kind"]) for r in read("name_parts", ["name_part", "position_kind"]).to_pylist() if r["name_part"]]
    label = Labeller(texts, parts)
    context = mp.get_context("fork")
    seeds = context.Queue()
    p, m1, m2 = initial(seed), {}, {}
    if go_on:
        seed, p = seed + 100, {k: v.astype(np.float32) for k, v in pt.weights().items()}
    for k in range(processes):
        seeds.put(seed + k)
    save = lambda: np.savez_compressed(pt.WEIGHTS, **{k: v.astype(np.float16) for k, v in p.items()})
    with context.Pool(processes, _begin, (texts, parts, label, seeds)) as pool:
        end, began, n, mean = time.time() + 60 * minutes, time.time(), 0, 0.0
        while (done := (time.time() - began) / (end - began)) < 1:
            found = pool.map(_one, [p] * processes, chunksize=1)
            loss, grads = sum(x for x, _ in found) / processes, {k: sum(g[k] for _, g in found) / processes for k in p}
            n += 1
            mean += (loss - mean) * max(0.02, 1 / n)
            rate = (2e-3 if go_on else 6e-3) * min(1, n / 60) * (1 - done + 0.01)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1.get(k, 0) + 0.1 * g
                m2[k] = 0.995 * m2.get(k, 0) + 0.005 * g * g
                p[k] = p[k] - (rate * (m1[k] / (1 - 0.9**n)) / (np.sqrt(m2[k] / (1 - 0.995**n)) + 1e-7)).astype(np.float32)
            if n % 50 == 0:
                print(n, round(time.time() - began), f"{mean:.5f}", flush=True)
                save()
    save()


if __name__ == "__main__":
    main(sys.argv[1], float(sys.argv[2]), "go_on" in sys.argv[3:])
