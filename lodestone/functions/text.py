"""Column functions on the text of notes: all built from Spark's own expressions.

Patterns run with (?d) and (?U): a dot stops at a newline only, and white space, digits and case
are Unicode's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Categories in the order in which they are tried, with the words that show them.
CATEGORY_WORDS = (
    ("decision", r"décidé|decided|choisi|chosen|validé|validated|mis en place|deployed|désactivé|disabled|activé|enabled|supprimé|deleted|créé|created|configuré|configured|migré|migrated|installé|installed|livré|shipped|GO|✅|fais-le|approuvé|approved|renamed|changé|changed|switched|updated to|upgraded to"),
    ("error", r"erreur|error|bug|fail|échec|crash|broken|corrompu|corrupted|fixé|fixed|résolu|resolved|workaround|⚠️|❌|panic|exception|timeout|429|500|502|503"),
    ("fact", r"version|v\d+\.\d+|released|publié|annoncé|announced|status|état|config|settings|port|url|ip address|token|key|password|api|endpoint|✅|mis à jour|updated|ajouté|added"),
    ("pattern", r"toujours|always|jamais|never|récurrence|recurring|pattern|habit|chaque|every|quotidien|daily|cron|schedule|régulier|regular"),
)
# Weight of each category in a score.
CATEGORY_WEIGHTS = {"decision": 3.0, "error": 2.0, "fact": 1.5, "pattern": 1.2, "transient": 1.0}
# Half-life of a score in days, its most, and what each further day adds.
HALF_LIFE_DAYS = 14.0
SCORE_CAP = 5.0
FREQUENCY_STEP = 1.3 - 1.0
# Fixed value: lines that say nothing.
NOISE = r"\A(?:\s*[-*]\s*\z|#{1,6}\s|\s*```|\s*\|.*\|\s*\z|---+|\s*(?:HEARTBEAT_OK|NO_REPLY))"
# Words that are no entities, and abbreviations that are none.
NO_ENTITY = ("The", "This", "That", "These", "Those", "Today", "Tonight", "Yesterday", "Tomorrow", "Morning", "Evening", "Afternoon", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
NO_ACRONYM = ("API", "URL", "IP", "SSH", "HTTP", "HTTPS", "DNS", "TCP", "UDP", "XML", "HTML", "CSS", "SQL", "JSON", "YAML", "TOML", "CSV", "PDF", "PNG", "JPG", "SVG", "UTC", "GMT", "CET")
# Kinds of secrets, in the order in which they are replaced.
SECRETS = (
    ("github_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("openai_key", r"sk-[A-Za-z0-9]{20,}"),
    ("google_key", r"AIza[A-Za-z0-9_\\-]{35}"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"),
    ("credential", r"(?i)(?:password|passwd|pwd|secret|token|api_key)\s*[:=]\s*\S+"),
    ("bearer", r"Bearer\s+[A-Za-z0-9._-]+"),
    ("slack_token", r"xox[baprs]-[A-Za-z0-9-]+"),
    ("private_key", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC )?PRIVATE KEY-----"),
)
# Paths never read.
SECRET_PATHS = r"(?i)\.secrets/|\.env$|credentials|token|password|\.git/"


# Words of a decision that is done; marks in front of an item (and of a cluster).
DONE = r"\[x\]|completed|done|terminé|livré"
ITEM_MARKS, CLUSTER_MARKS = "TODO|DONE|✅|❌|⚠️", "TODO|DONE|✅|❌|⚠️|🔵"
# Formatting that is taken off, forms of entities, names of notes.
BOLD, CODE, LINK, BULLETS = r"\*\*(.+?)\*\*", r"`(.+?)`", r"\[([^\]]+)\]\([^)]+\)", "-* "
CAPITALISED, VERSION, ACRONYM = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", r"\b(v\d+\.\d+(?:\.\d+)?)\b", r"\b([A-Z]{2,5})\b"
NOTE_NAME = r"\A(\d{4}-\d{2}-\d{2})(?:-.+)?\.md\z"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def category(c: Column) -> Column:
    """The first category of which a word occurs anywhere, else ``transient``; null for null."""
    found = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, words in CATEGORY_WORDS:
        found = found.when(c.rlike(f"(?diU)(?:{words})"), name)
    return found.otherwise("transient")


def category_weight(c: Column) -> Column:
    w = F.when(c == "decision", CATEGORY_WEIGHTS["decision"])
    for name in ("error", "fact", "pattern"):
        w = w.when(c == name, CATEGORY_WEIGHTS[name])
    return w.otherwise(CATEGORY_WEIGHTS["transient"])


def decay(day: Column, as_of: Column) -> Column:
    """0.5 ** (days / 14); 1 for days that are not past."""
    return F.pow(F.lit(0.5), F.greatest(F.datediff(as_of, day), F.lit(0)) / F.lit(HALF_LIFE_DAYS))


def frequency_boost(days: Column) -> Column:
    return F.when(days > 1, 1 + F.log(days.cast("double")) * FREQUENCY_STEP).otherwise(1.0)


def entity_boost(n: Column) -> Column:
    return F.when(n > 2, 1 + 0.1 * F.least(n - 2, F.lit(3))).otherwise(1.0)


def completion_factor(kind: Column, text: Column) -> Column:
    done = text.rlike(f"(?diU){DONE}")
    return F.when((kind == "decision") & done, 0.5).otherwise(1.0)


def score(kind: Column, day: Column, as_of: Column, days: Column, entities: Column, text: Column) -> Column:
    """Weight, recency, frequency, entities and completion multiplied, at most 5, to four decimals."""
    product = category_weight(kind) * decay(day, as_of) * frequency_boost(days) * entity_boost(entities) * completion_factor(kind, text)
    return F.round(F.least(product, F.lit(SCORE_CAP)), 4)


def _grouping_key(c: Column, marks: str, clock: bool, size: int) -> Column:
    x = strip(F.lower(c))
    x = F.regexp_replace(x, r"(?U)\A[-*]\s+", "")
    x = F.regexp_replace(x, rf"(?U)\A(?:{marks})\s*", "")
    x = F.regexp_replace(x, r"(?U)\d{4}-\d{2}-\d{2}", "")
    if clock:
        x = F.regexp_replace(x, r"(?U)\d+:\d+", "")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    return strip(F.substring(x, 1, size))


def text_key(c: Column, size: int = 60) -> Column:
    """Key under which an item recurs: lower case, without bullet, mark, dates and extra blanks."""
    return _grouping_key(c, ITEM_MARKS, False, size)


def cluster_key(c: Column, size: int = 60) -> Column:
    """As text_key, without times of day too."""
    return _grouping_key(c, CLUSTER_MARKS, True, size)


def plain(c: Column) -> Column:
    """Without bold, code, links and leading bullets."""
    x = F.regexp_replace(c, f"(?dU){BOLD}", "$1")
    x = F.regexp_replace(x, f"(?dU){CODE}", "$1")
    x = F.regexp_replace(x, LINK, "$1")
    return strip(F.ltrim(x, F.lit(BULLETS)))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def entities(c: Column, most: int = 5) -> Column:
    """Capitalised words (one or two), versions and acronyms in this order, each once whatever
    its case, at most ``most``."""
    all_of = lambda p: F.regexp_extract_all(c, F.lit(f"(?U){p}"), 1)
    found = F.concat(
        F.filter(all_of(CAPITALISED), lambda w: ~w.isin(*NO_ENTITY)), all_of(VERSION), F.filter(all_of(ACRONYM), lambda w: ~w.isin(*NO_ACRONYM))
    )
    first = lambda f, low: F.slice(F.filter(f, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), 1, most)
    return _once(found, lambda f: _once(F.transform(f, F.lower), lambda low: first(f, low)))


@F.pandas_udf(T.DoubleType())
def _rounded(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else round(v, int(d)) for v, d in zip(x, digits)], dtype="float64")


def exact_round(c: Column, digits: int) -> Column:
    """Rounding by the exact binary value, ties to even, where Spark's round goes by the decimal
    one: 0.01875 has no exact form and becomes 0.0187.  An Arrow function, for comparisons only."""
    return _rounded(c.cast("double"), F.lit(digits))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def redact_secrets(c: Column) -> Column:
    """Each kind of secret replaced by [REDACTED], one kind after the other."""
    for _, pattern in SECRETS:
        c = F.regexp_replace(c, pattern, "[REDACTED]")
    return c


def secret_count(c: Column, kind: str) -> Column:
    """Occurrences of one kind in the text as it is."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(dict(SECRETS)[kind]), 0)), F.lit(0))


def note_date(file_name: Column) -> Column:
    """Date of ``YYYY-MM-DD[-suffix].md``, null for other names and impossible dates."""
    return F.try_to_date(F.regexp_extract(file_name, NOTE_NAME, 1), "yyyy-MM-dd")


def category_of_file(file_name: Column) -> Column:
    """The first two parts of a name of three or more parts, else the name without ending."""
    base = F.regexp_replace(file_name, r"\.md", "")
    parts = F.split(base, "-")
    return F.when(F.size(parts) > 2, F.concat_ws("-", parts[0], parts[1])).otherwise(base)


def lines(content: Column) -> Column:
    """Lines of a text under their section: array of struct(part, line, section, text).

    A line that begins with ``## `` opens a section and is no line of it; ``general`` comes
    before the first.  Within the text no shuffle is needed for this.
    """
    header = r"(?U)\A[^\S\n]*## [^\n]*\S"
    parts = F.split(content, r"(?U)(?<=\n)(?=[^\S\n]*## [^\n]*\S)")

    def of_part(part: Column, i: Column) -> Column:
        headed = part.rlike(header)
        rows = F.split(F.when((i < F.size(parts) - 1) & part.endswith("\n"), F.regexp_replace(part, r"\n\z", "")).otherwise(part), "\n")
        name = F.when(headed, strip(F.ltrim(strip(rows[0]), F.lit("# ")))).otherwise("general")
        body = F.when(headed, F.slice(rows, 2, F.size(rows))).otherwise(rows)
        return F.transform(body, lambda t, k: F.struct(i.alias("part"), k.alias("line"), name.alias("section"), t.alias("text")))

    return F.flatten(F.transform(parts, of_part))
