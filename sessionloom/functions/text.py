"""Text functions as Spark columns: keys, credentials, noise, titles, folding, words, paths.

Everything stays on the JVM side; none of these is a Python UDF. Patterns are Java regular
expressions; where a word boundary must be ASCII-only it is written as a look-around.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key pattern, prefixes that look like keys but are none, branches without meaning.
KEY_PATTERN = r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9]{1,9}-[0-9]{1,6}(?![A-Za-z0-9_])"
NOT_KEYS = "UTF SHA ISO MD AES RSA HTTP TLS SSL RFC CVE WCAG ES X TCP UDP PNG JPEG IPV EC HS RS IE COVID GPT BASE CRC UUID JWT PDF CSS ARIA SIGINT".split()
GENERIC_BRANCHES = ("main", "master", "HEAD", "develop", "dev", "")
# What begins a text that the tool, not the person, wrote.
INJECTED = ("<system-reminder>", "<command-", "<local-command", "<task-notification", "Caveat:")
NOISE = ("[Request interrupted", "<bash-", "This session is being continued")
COMPACTION = "This session is being continued"
# Credentials.
SECRET = r"(eyJ[A-Za-z0-9_-]{15,}\.[A-Za-z0-9_-]{10,}|sk-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{12,}|xox[bap]-[A-Za-z0-9-]{10,})"
ASSIGNED_SECRET = r"(?i)(?:password|passwd|secret|token|apikey|api_key)\s*[=:]\s*\S+"
MASK = "[REDACTED]"
# Editor tags, commands, greetings, task-switch openers.
TAG_BLOCK = r"(?is)<(ide_[a-z_]+|system-reminder|local-command-[a-z]+|command-[a-z]+|task-notification|user-prompt-submit-hook)\b[^>]*>.*?</\1>"
ANY_TAG = r"(?i)</?[a-z][\w:-]*(?:\s[^<>]*)?/?>"
COMMAND = r"(?i)^/[a-z][\w:-]*(?:\s+|$)"
GREETING = r"(?i)^(?:hola|hi|hello|hey|buenas|buenos d[ií]as|buenas tardes|buenas noches|good (?:morning|afternoon|evening)|thanks|thank you|gracias|ok|okay)(?![A-Za-z0-9_])"
CUE = r"(?i)^[^A-Za-z0-9_]*(now\s+let'?s|now\s+i\s+want|new\s+task|different\s+topic|switching\s+to|unrelated|ahora|quiero\s+que\s+ahora|recuerdas|cambiando|otra\s+cosa|otro\s+tema|nueva\s+tarea)"
# Words without a topic, parts of paths without meaning.
STOP_WORDS = (
    "para pero como esto esta este esos esas que los las del una uno con por sus muy mas hay ese eso "
    "sin sobre entre desde hasta cuando donde porque quiero puedes puede hacer haz hace hecho solo ahora "
    "the and for that this with from have not you are was but can will all any then there here "
    "please want need make just now also should would could http https www com html json"
).split()
PATH_WORDS = "users home src claude worktrees tmp private var documents apps".split()
# Classes of git commands.
GIT_WORK = r"\bgit\s+(commit|push|checkout|switch|merge|rebase|cherry-pick)\b"
GIT_PUBLISH = r"\bgit\s+(?:-C\s+\S+\s+)?(commit|push)\b"
GIT_REVERT = r"\bgit\s+(?:checkout|restore|reset|stash|clean|rm)\b|(?:^|[\s;&|])rm\s"
GIT_RESET = r"\bgit\s+reset\b"
GIT_REVERT_ALL = r"\bgit\s+(?:checkout\s+(?:--\s+)?\.(?:\s|$)|restore\s+(?:--staged\s+)?\.(?:\s|$)|reset\s+--hard|clean\b|stash(?!\s+(?:pop|apply|list|show|drop)))"
COMMIT_LINE = r"^\[([^\]\s]+)(?: \(root-commit\))? ([0-9a-f]{7,40})\] (.+)$"
PUSH_LINE = r"^\s*([0-9a-f]{7,40})\.\.([0-9a-f]{7,40})\s+\S+\s+->\s+(\S+)"
MIN_WORDS, TITLE_MAX, MAX_WORD = 4, 80, 40


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nn(c) -> Column:
    """Null as the empty string."""
    return F.coalesce(col(c), F.lit(""))


def starts_with_any(text, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(col(text), F.lit(p))
    return out


def redact(text) -> Column:
    masked = F.lit(MASK)
    return F.regexp_replace(F.regexp_replace(nn(text), F.lit(SECRET), masked), F.lit(ASSIGNED_SECRET), masked)


def count_redactions(text) -> Column:
    first = F.regexp_replace(nn(text), F.lit(SECRET), F.lit(MASK))
    return F.regexp_count(nn(text), F.lit(SECRET)) + F.regexp_count(first, F.lit(ASSIGNED_SECRET))


def find_keys(text, pattern: str = KEY_PATTERN) -> Column:
    """All keys of a text, in order, repeats included."""
    stop = F.array(*[F.lit(p) for p in NOT_KEYS])
    found = F.regexp_extract_all(nn(text), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda k: (k != "") & ~F.array_contains(stop, F.regexp_replace(F.element_at(F.split(k, "-"), 1), "[0-9]+$", "")))


def key_pattern(patterns: list[str]) -> str:
    """One Java pattern of up to 20 patterns of up to 300 characters; a bad one is named in the error."""
    import re

    if len(patterns) > 20:
        raise ValueError("at most 20 key patterns")
    for p in patterns:
        try:
            re.compile(p)
        except re.error as e:
            raise ValueError(f"bad key pattern {p!r}: {e}") from None
        if len(p) > 300:
            raise ValueError(f"key pattern {p[:20]!r}... is longer than 300 characters")
    ascii_boundary = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    return "|".join(f"(?:{p})" for p in patterns).replace(r"\b", ascii_boundary)


def is_noise(text) -> Column:
    return starts_with_any(nn(text), NOISE)


def is_compaction(text) -> Column:
    return F.startswith(nn(text), F.lit(COMPACTION))


def one_line(text) -> Column:
    return F.trim(F.regexp_replace(nn(text), r"(?U)\s+", " "))


def strip_tags(text) -> Column:
    return one_line(F.regexp_replace(F.regexp_replace(nn(text), F.lit(TAG_BLOCK), F.lit(" ")), F.lit(ANY_TAG), F.lit(" ")))


def word_count(text) -> Column:
    """Words with at least one letter."""
    found = F.regexp_extract_all(nn(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’_-]*"), F.lit(0))
    return F.size(F.filter(found, lambda w: w.rlike(r"\p{L}")))


def meaningful(text) -> Column:
    """What a message says about its task, '' if it says nothing."""
    t = strip_tags(text)
    bare = F.trim(F.regexp_replace(t, F.lit(COMMAND), F.lit("")))
    empty = (t == "") | is_noise(t) | (bare == "") | (bare.rlike(GREETING) & (F.length(bare) <= 40)) | (word_count(bare) < MIN_WORDS)
    return F.when(empty, F.lit("")).otherwise(bare)


def cut_title(text, most: int = TITLE_MAX) -> Column:
    """One line of at most `most` characters, cut at a word where possible, closed with an ellipsis."""
    t = one_line(text)
    head = F.substring(t, 1, most - 1)
    space = F.length(head) - F.instr(F.reverse(head), " ")  # 0-based place of the last blank
    cut = F.when((F.instr(head, " ") > 0) & (space >= most // 2), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(cut, r"[\s,;:.\-–—]+$", ""), F.lit("…")))


@functools.lru_cache(maxsize=1)
def fold_map() -> tuple[str, str]:
    """Code points and what they fold to: lower case without marks, always one to one."""
    src, dst = [], []
    for cp in range(128, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        bare = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.category(c).startswith("M")).lower()
        if len(bare) != 1:
            bare = ch.lower() if len(ch.lower()) == 1 else ch
        if bare != ch:
            src.append(ch)
            dst.append(bare)
    return "".join(src), "".join(dst)


def fold(text) -> Column:
    """Lower case without accents, of the same length. ASCII texts skip the table."""
    src, dst = fold_map()
    t = nn(text)
    return F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(F.translate(t, src, dst), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(t))


def query_words(text) -> Column:
    return F.filter(F.split(fold(text), r"\s+"), lambda w: w != "")


def words(text) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens(text) -> Column:
    """Topic words: no accents, links, hashes, tags or stop words."""
    t = F.regexp_replace(fold(text), F.lit(r"https?://\S+|(?<![A-Za-z0-9_])[0-9a-f]{7,40}(?![A-Za-z0-9_])|<[^>]{0,80}>"), F.lit(" "))
    found = F.regexp_extract_all(t, F.lit("[a-z][a-z0-9]{2,}"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


def path_tokens(path, noise: tuple[str, ...] = ()) -> Column:
    """Words of a path; `noise` adds words to drop, such as the user's name."""
    parts = F.split(nn(path), r"[/\\._-]")
    found = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"), F.lit(0))))
    drop = F.array(*[F.lit(w) for w in (*PATH_WORDS, *noise)])
    return F.filter(F.transform(found, lambda w: F.lower(w)), lambda w: (F.length(w) > 2) & ~F.array_contains(drop, w))


def basename(path) -> Column:
    return F.element_at(F.split(F.regexp_replace(nn(path), r"[\\/]+$", ""), r"[\\/]"), -1)


def short_path(path, cwd) -> Column:
    """`<repo>/<path in repo>`: worktrees map to their repo, else the working folder is cut off."""
    p, base = nn(path), F.regexp_replace(nn(cwd), "/+$", "")
    tree = r"^(.*?)/\.claude/worktrees/[^/]+/(.*)$"
    in_tree = F.concat(basename(F.regexp_extract(p, tree, 1)), F.lit("/"), F.regexp_extract(p, tree, 2))
    inside = (base != "") & F.startswith(p, F.concat(base, F.lit("/")))
    return F.when(p.rlike(tree), in_tree).when(inside, F.concat(basename(base), F.lit("/"), F.substring(p, F.length(base) + 2, F.length(p)))).otherwise(p)


def is_work_file(path) -> Column:
    p = nn(path)
    scratch = F.contains(p, F.lit("/.claude/")) | starts_with_any(p, ("/tmp/", "/private/tmp/", "/var/folders/"))
    note = (basename(p) == "HANDOFF.md") & F.contains(p, F.lit("/docs/handoff/"))
    return F.contains(p, F.lit("/.claude/worktrees/")) | (~scratch & ~note)


def local_day(ts, tz: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), tz))


def to_ts(text) -> Column:
    """Timestamp of an ISO string, null if there is none."""
    return F.try_to_timestamp(col(text))


def valid_day(text) -> Column:
    """The day of a well-formed, existing YYYY-MM-DD, else null."""
    return F.when(nn(text).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(col(text), "yyyy-MM-dd"))


def clip01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def first_match(folded, terms: Column) -> Column:
    """1-based place of the first match of any term, null if none matches."""
    places = F.filter(F.transform(terms, lambda w: F.call_function("instr", folded, w)), lambda i: i > 0)
    return F.array_min(places)


def snippet(text, terms: Column, before: int = 50, after: int = 110) -> Column:
    """struct(excerpt, cut_before, cut_after) around the first match; blanks flattened."""
    t, f = nn(text), fold(text)
    at = first_match(f, terms) - 1
    start, end = F.greatest(F.lit(0), at - before), F.least(F.length(t), at + after)
    excerpt = F.regexp_replace(F.substring(t, start + 1, end - start), r"(?U)\s", " ")
    return F.struct(F.when(at.isNull(), F.lit("")).otherwise(excerpt).alias("excerpt"), (at.isNotNull() & (start > 0)).alias("cut_before"), (at.isNotNull() & (end < F.length(t))).alias("cut_after"))


def highlight_ranges(folded, terms: Column) -> Column:
    """Merged [start, end) ranges of all terms in a folded text, 0-based."""
    f = nn(folded)
    every = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(f)))
    hits = F.flatten(F.transform(terms, lambda w: F.transform(F.filter(every, lambda i: F.substring(f, i, F.length(w)) == w), lambda i: F.struct((i - 1).alias("s"), (i - 1 + F.length(w)).alias("e")))))
    ordered = F.array_sort(hits)
    empty = F.array().cast("array<struct<s:int,e:int>>")
    last = lambda a: F.element_at(a, -1)
    merged = lambda a, x: F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["s"].alias("s"), F.greatest(last(a)["e"], x["e"]).alias("e"))))
    return F.aggregate(ordered, empty, lambda a, x: F.when((F.size(a) > 0) & (x["s"] <= F.get(a, F.size(a) - 1)["e"]), merged(a, x)).otherwise(F.concat(a, F.array(x))))
