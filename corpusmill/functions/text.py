"""Column functions on text. All stay in the JVM; null in gives null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace between words, as Python's str.split() has it; Java's \s knows ASCII only.
SPACES = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN = r"[\p{L}\p{N}_]+"
EDGES = ".,;:!?\"'()[]{}"

# Words that make no specific probe.
PROBE_STOPWORDS = (
    "about after again also another because before between could every first from have here into more most other over same should "
    "some such than that their them then there these they this those through under very what when where which while with would your"
).split()

# Words that do not count as key tokens of a claim.
GATE_STOPWORDS = (
    "a an the is in of to and or for on at by this that with from as are was were be been have has had not no it its i we you he she "
    "they do did but so if when which who what where how can will would could should may might shall all any each into than then "
    "their there these those my your our also just more about up out over after before such between s t re ve ll d m"
).split()

# Phrases that mark a sentence as a refusal, so as no claim.
REFUSALS = [
    "can't confirm",
    "cannot confirm",
    "could not confirm",
    "could not find",
    "do not have enough",
    "don't have enough",
    "not enough information",
    "no references",
    "no mentions",
    "not in your notes",
]

# Secrets, in the order in which they are blanked.
SECRETS = [
    r"eyJ[A-Za-z0-9+/=]{20,}",
    r"\b[0-9a-fA-F]{32,}\b",
    r"\b[A-Za-z0-9+]{40,}={0,2}\b",
]
SECRET_KEYS = "password secret token api_key apikey credential auth bearer access_token refresh_token".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space, in order."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def has_all_tokens(text: Column, query: Column) -> Column:
    """Whether every token of ``query`` occurs in ``text``, in any order. A query without tokens matches nothing.

    A token occurs where it stands with no character of a token at either side; looking ends at the first such place.
    """
    wanted = tokens(query)
    part = TOKEN[:-2] + "\U00010000]"  # a letter like others: one beyond U+FFFF in the pattern makes Java look back by whole characters
    alone = lambda t: F.concat(t, F.lit(f"(?<!{part}"), t, F.lit(f")(?!{part})"))
    return (F.size(wanted) > 0) & let(F.lower(text), lambda low: F.forall(wanted, lambda t: F.contains(low, t) & F.regexp_like(low, alone(t))))


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` stands in ``text``, whatever the case, without overlaps. An empty term: 0."""
    low, t = F.lower(text), F.lower(term)
    return F.when(F.length(t) > 0, ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("long")).otherwise(F.lit(0).cast("long"))


def contains_folded(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot is no extension."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def title(text: Column, path: Column) -> Column:
    """The first heading of level one, else the file's stem."""
    heading = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    found = F.regexp_replace(heading, f"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.when(F.length(found) > 0, found).otherwise(stem(path))


def looks_like_text(content: Column) -> Column:
    """Whether bytes look like text: no NUL, and at most 30 % control bytes. No bytes do."""
    letters = F.decode(content, "ISO-8859-1")
    odd = F.regexp_count(letters, F.lit(r"[\x01-\x08\x0e-\x1a\x1c-\x1f]"))
    return F.when(F.length(content) == 0, True).when(F.regexp_count(letters, F.lit(r"\x00")) > 0, False).otherwise(odd <= 0.3 * F.length(content))


# Characters that are no letters, marks, numbers, punctuation or white space; and those that are replacement or control characters.
NOT_GOOD = rf"[^\p{{L}}\p{{M}}\p{{N}}\p{{P}}{SPACES}]"
BAD = r"[\x{FFFD}\p{Cf}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]"


def share_of(text: Column, count: Column, empty: float) -> Column:
    return F.when(F.length(text) == 0, empty).otherwise(count / F.nullif(F.length(text), F.lit(0)))


def good_ratio(text: Column) -> Column:
    """Share of letters, marks, numbers, punctuation and white space; empty: 1. The few others are counted: a match is an object."""
    return share_of(text, F.length(text) - F.regexp_count(text, F.lit(NOT_GOOD)), 1.0)


def bad_ratio(text: Column) -> Column:
    """Share of replacement and control characters other than white space; empty: 0."""
    return share_of(text, F.regexp_count(text, F.lit(BAD)), 0.0)


def page_verdict(text: Column) -> Column:
    """Verdict on text taken from pages: scanned, low_confidence or ok."""
    return quality(text)["verdict"]


def quality(text: Column) -> Column:
    """Struct of good, bad and verdict, each counted once."""
    scanned = F.length(F.replace(text, F.lit("\n"), F.lit(""))) < 100
    verdict = lambda r: F.when(scanned, "scanned").when((r["good"] < 0.7) | (r["bad"] > 0.1), "low_confidence").otherwise("ok")
    ratios = F.struct(good_ratio(text).alias("good"), bad_ratio(text).alias("bad"))
    return let(ratios, lambda r: F.struct(r["good"].alias("good"), r["bad"].alias("bad"), verdict(r).alias("verdict")))


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def redact_map(detail: Column) -> Column:
    """A map of strings with secrets blanked, and all values under a secret's name."""
    return F.transform_values(detail, lambda k, v: F.when(F.lower(k).isin(SECRET_KEYS), F.lit("[REDACTED]")).otherwise(redact(v)))


def first_words(text: Column, n: int = 10) -> Column:
    head = F.split(text, f"[{SPACES}]+", n + 2)  # an empty string before leading space, n words, and the rest as it is
    return F.array_join(F.slice(F.filter(head, lambda w: w != ""), 1, n), " ")


def body_lines(text: Column) -> Column:
    """The text without its heading lines."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]")
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(f"^[{SPACES}]*#")), "\n")


def specific_word(text: Column) -> Column:
    """The first word of five letters or more that is no stop word, without marks around it; none: null. It is looked for among
    the first words, and in the whole text only if none of them is one."""

    def first(found: Column) -> Column:
        bare = F.transform(found, lambda w: F.btrim(w, F.lit(EDGES)))
        fit = F.filter(bare, lambda w: (F.length(w) >= 5) & w.rlike(r"^\p{L}+$") & ~F.lower(w).isin(PROBE_STOPWORDS))
        return F.get(fit, F.lit(0))

    return F.coalesce(first(F.slice(F.split(text, f"[{SPACES}]+", 33), 1, 32)), first(words(text)))


def body_word(text: Column) -> Column:
    """The specific word of the lines that are no headings, else of the text."""
    return F.when(F.contains(text, F.lit("#")), F.coalesce(specific_word(body_lines(text)), specific_word(text))).otherwise(specific_word(text))


def gate_tokens(text: Column) -> Column:
    """Distinct key tokens of a claim: ASCII letters and digits, no stop words, two characters or more."""
    parts = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(GATE_STOPWORDS)))


def sentences(answer: Column) -> Column:
    """Sentences of an answer, without inline citations."""
    plain = F.regexp_replace(answer, r"(?i)\[source:[^\]]+\]", "")
    trimmed = F.transform(F.split(plain, rf"(?<=[.!?])[{SPACES}]+"), lambda s: F.regexp_replace(s, f"^[{SPACES}]+|[{SPACES}]+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def is_refusal(sentence: Column) -> Column:
    low = F.lower(sentence)
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.contains(low, F.lit(phrase))
    return out
