"""Text: words, trigrams, titles, redaction, dates as shown to readers. All are Column builders."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def trimmed(text: Column) -> Column:
    """Without white space at both ends, line feeds and tabs included."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def trigrams(text: Column) -> Column:
    """Distinct three-character runs of each lower-cased word, two spaces before it and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    runs = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))
    return F.array_distinct(F.flatten(runs))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Shared over all distinct trigrams of two texts; 0 without any."""
    shared, every = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.coalesce(F.try_divide(shared.cast("double"), every.cast("double")), F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    """A token for each four characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4.0)).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def title(text: Column, most: int = 50) -> Column:
    """The text if it is short; else cut at `most` characters, back to its last space if that isn't the first, and marked."""
    t = trimmed(text)
    head = F.substring(t, 1, most)
    at_space = most - F.locate(" ", F.reverse(head)) + 1  # place of the last space
    cut = F.when((F.locate(" ", head) > 0) & (at_space > 1), F.substring(head, F.lit(1), at_space - 1)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("...")))


# The first rule with a word that the lower-cased title contains gives the sign.
TITLE_SIGNS = [
    (("bug", "error", "erreur"), "🐛"),
    (("test",), "🧪"),
    (("database", "db", "base de donnees"), "🗄️"),
    (("api", "endpoint"), "🔌"),
    (("security", "securite", "auth"), "🔒"),
    (("performance", "optimis"), "⚡"),
    (("refactor",), "🔧"),
    (("feature", "fonctionnalite"), "✨"),
    (("doc",), "📝"),
    (("deploy", "ci", "cd"), "🚀"),
]
OTHER_SIGN = "💬"


def title_sign(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit(OTHER_SIGN)
    for keys, sign in reversed(TITLE_SIGNS):
        out = F.when(low.rlike("|".join(keys)), F.lit(sign)).otherwise(out)
    return out


# What is redacted, in this order, whatever its case.
REDACTED = [
    r"Bearer\s+[A-Za-z0-9\-._~+/]+=*",
    r"ghp_[A-Za-z0-9]{36}",
    r"gho_[A-Za-z0-9]{36}",
    r"ghs_[A-Za-z0-9]{36}",
    r"sk-[A-Za-z0-9]{20,}",
    r"sk_test_[A-Za-z0-9]{20,}",
    r"sk_live_[A-Za-z0-9]{20,}",
    r"whsec_[A-Za-z0-9]{32,}",
    r"""password["\s:=]+[^\s,}"]+""",
    r"""secret["\s:=]+[^\s,}"]+""",
    r"""token["\s:=]+[^\s,}"]+""",
    r"""api[_-]?key["\s:=]+[^\s,}"]+""",
]
# Words of a key whose value is redacted whole.
SENSITIVE_KEY = "token|secret|password|key|authorization"


def redact(text: Column) -> Column:
    """What a pattern finds is replaced, pattern by pattern; a text in which none finds anything is looked at once."""
    out = text
    for pattern in REDACTED:
        out = F.regexp_replace(out, "(?i)" + pattern, "[REDACTED]")
    return F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in REDACTED)), out).otherwise(text)


def redacted_value(value, key: str = ""):
    """A JSON value without secrets: a mark in place of a sensitive key's value, objects walked to any depth, texts redacted inside;
    lists stay as they are."""
    if re.search(SENSITIVE_KEY, key.lower()):
        return "[REDACTED]"
    if isinstance(value, dict):
        return {k: redacted_value(v, k) for k, v in value.items()}
    if isinstance(value, str):
        for pattern in REDACTED:
            value = re.sub(pattern, "[REDACTED]", value, flags=re.I | re.A)
    return value


def redact_json(text: Column) -> Column:
    """JSON objects without secrets at any depth, keys in their order; null for a text that is no JSON."""
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(redacted_value(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return F.pandas_udf(run, "string")(text)


def redact_map(values: Column) -> Column:
    """Values of sensitive keys replaced, those of others redacted inside."""
    return F.transform_values(
        values, lambda k, v: F.when(F.lower(k).rlike(SENSITIVE_KEY), F.lit("[REDACTED]")).otherwise(redact(v))
    )


def calendar_group(at: Column, now: Column) -> Column:
    """today, yesterday, this_week (from Monday), this_month or older, by calendar."""
    day, today = F.to_date(at), F.to_date(now)
    return (
        F.when(day >= today, "today")
        .when(day == F.date_sub(today, 1), "yesterday")
        .when(day >= F.to_date(F.date_trunc("week", now)), "this_week")
        .when(day >= F.to_date(F.date_trunc("month", now)), "this_month")
        .otherwise("older")
    )


def seconds_between(at: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(1_000_000)).cast("long")


def rolling_group(at: Column, now: Column) -> Column:
    """The same names by whole days of 24 hours that have passed."""
    days = F.floor(seconds_between(at, now) / F.lit(86_400))
    return (
        F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, "this_week").when(days < 30, "this_month").otherwise("older")
    )


def relative_time(at: Column, now: Column) -> Column:
    """How long ago, in French; the date itself from 30 days on."""
    s = seconds_between(at, now)
    minutes, hours, days = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long"), F.floor(s / 86_400).cast("long")
    weeks = F.floor(days / 7).cast("long")
    plural = lambda n, word: F.concat(F.lit("il y a "), n.cast("string"), F.lit(f" {word}"), F.when(n > 1, "s").otherwise(""))
    return (
        F.when(s < 60, "à l'instant")
        .when(minutes < 60, plural(minutes, "minute"))
        .when(hours < 24, plural(hours, "heure"))
        .when(days == 1, "hier")
        .when(days < 7, F.concat(F.lit("il y a "), days.cast("string"), F.lit(" jours")))
        .when(days < 30, plural(weeks, "semaine"))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


def abbreviated(n: Column) -> Column:
    """Thousands as k and millions as M, with one decimal for millions."""
    return (
        F.when(n >= 1_000_000, F.concat(F.round(n / 1_000_000, 1).cast("decimal(20,1)").cast("string"), F.lit("M")))
        .when(n >= 1000, F.concat(F.round(n / 1000, 0).cast("long").cast("string"), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def message_text(content: Column, parts: Column) -> Column:
    """The content, or else the texts of the parts (type, text) of type text, joined."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"])
    return F.coalesce(content, F.array_join(texts, ""), F.lit(""))


def json_array(text: Column) -> Column:
    """The strings of the JSON array that begins at the first [ and ends at the last ]; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), "array<string>")


def client_key(user: Column, forwarded: Column) -> Column:
    """user:id, else ip: and the first hop of the forwarded-for header, else unknown."""
    hop = F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit(""))
    return F.coalesce(F.concat(F.lit("user:"), user), F.concat(F.lit("ip:"), hop), F.lit("unknown"))


def line_range(start: Column, end: Column) -> Column:
    """5 or 5-9."""
    return F.when(end.isNull() | (start == end), start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def is_uuid(text: Column) -> Column:
    return text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def sections(*parts: Column) -> Column:
    """Non-empty parts with an empty line between them, as prompts are put together."""
    return F.concat_ws("\n\n", *[F.when(F.length(p) > 0, p) for p in parts])


def _lines(start: Column, end: Column, before: str, between: str) -> Column:
    one = F.concat(F.lit(before), start.cast("string"))
    both = F.concat(one, F.lit(between), end.cast("string"))
    return F.when(start.isNull(), "").when(end != start, both).otherwise(one)


def line_label(start: Column, end: Column) -> Column:
    """:5 or :5-9, as shown behind a path; empty without a line."""
    return _lines(start, end, ":", "-")


def line_hash(start: Column, end: Column) -> Column:
    """#L5 or #L5-L9, the mark of lines in a link; empty without a line."""
    return _lines(start, end, "#L", "-L")


def owner_of(full_name: Column) -> Column:
    return F.get(F.split(full_name, "/"), F.lit(0))


def repository_of(full_name: Column) -> Column:
    """What stands behind the first slash, up to the next; null without one."""
    return F.get(F.split(full_name, "/"), F.lit(1))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def has_newer(indexed: Column, latest: Column) -> Column:
    """Whether the latest commit is another than the indexed one; null if either isn't known."""
    return latest != indexed


# The words of this text are fixed values.
def indexing_time(lines: Column) -> Column:
    """A rough time for so many lines, at 1,000 a second, as shown to readers."""
    up = lambda c, by: F.ceil(c / F.lit(float(by))).cast("long")
    seconds = up(lines, 1000)
    minutes = up(seconds, 60)
    hours = up(minutes, 60)
    many = lambda n, unit: F.concat(F.lit("~"), n.cast("string"), F.lit(" " + unit), F.when(n > 1, "s").otherwise(""))
    return F.when(seconds < 60, F.concat(F.lit("~"), seconds.cast("string"), F.lit(" secondes"))).when(minutes < 60, many(minutes, "minute")).otherwise(many(hours, "heure"))
