"""Column functions on texts: cleaning, redaction, leak detection, snippets, names and dates.

Built-in expressions only. White space follows Unicode plus the information separators; matching
that ignores case does so for all letters, unless it says ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions.instants import is_instant

# Text patterns and word lists that results depend on.
WS = r"\s\x1c-\x1f"
ASSIGN = rf"""["']?[ \t]*[=:][ \t]*["']?"""
REDACTIONS = [
    (r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_\-]+", "[REDACTED]"),
    (rf"(?iU)(api[_-]?key{ASSIGN})([^{WS}\"']+)", "$1[REDACTED]"),
    (rf"(?iU)(password{ASSIGN})([^{WS}\"']+)", "$1[REDACTED]"),
    (rf"(?U)(\b[A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)=[\"']?)(?![/~$])([^{WS}\"']{{8,}})", "$1[REDACTED]"),
    (rf"(?iU)((?:client_secret|secret|token){ASSIGN})([^{WS}\"']{{12,}})", "$1[REDACTED]"),
    (rf"(?U)(Bearer[ \t]+)(?![Tt]oken\b)[^{WS}]+", "$1[REDACTED]"),
    (r"(?<![A-Za-z0-9])(?:sk|pk|rk|whsec|stripe)_live_[A-Za-z0-9]+", "[REDACTED]"),
    (r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}", "[REDACTED]"),
    (r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED]"),
    (r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9\-]{10,}", "[REDACTED]"),
    (r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+", "[REDACTED]"),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
]
LEAKS = [
    r"(?<![A-Za-z0-9])sk-(?!\[REDACTED\])[A-Za-z0-9]",
    rf"(?iU)api[_-]?key{ASSIGN}(?!\[REDACTED\])[^{WS}\"']",
    rf"(?iU)password{ASSIGN}(?!\[REDACTED\])[^{WS}\"']",
    rf"(?U)\b[A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)=[\"']?(?![/~$])(?!\[REDACTED\])[^{WS}\"']{{8,}}",
    rf"(?iU)(?:client_secret|secret|token){ASSIGN}(?!\[REDACTED\])[^{WS}\"']{{12,}}",
    rf"(?U)Bearer[ \t]+(?![Tt]oken\b)(?!\[REDACTED\])[^{WS}]",
    r"(?<![A-Za-z0-9])(?:sk|pk|rk|whsec|stripe)_live_(?!\[REDACTED\])[A-Za-z0-9]",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}",
    r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}",
    r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9\-]{10,}",
    r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
]
MARKERS = [r"sk-[A-Za-z0-9]", r"api[_-]?key *[=:]", r"Bearer ", r"password *[=:]", r"_live_[A-Za-z0-9]"]
NOTE_REDACTIONS = [
    (r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_\-]+", "[REDACTED]"),
    (rf"(?iU)api[_-]?key{ASSIGN}[^{WS}\"']+", "[REDACTED-CREDENTIAL]"),
    (rf"(?iU)password{ASSIGN}[^{WS}\"']+", "[REDACTED-PASSWORD]"),
    (rf"(?U)(\b[A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)=[\"']?)(?![/~$])[^{WS}\"']{{8,}}", "$1[REDACTED]"),
    (rf"(?U)(Bearer[ \t]+)(?![Tt]oken\b)[^{WS}]+", "$1[REDACTED]"),
    (r"(?<![A-Za-z0-9])(?:sk|pk|rk|whsec)_live_[A-Za-z0-9]+", "[REDACTED]"),
    (r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}", "[REDACTED]"),
    (r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED]"),
    (r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+", "[REDACTED]"),
]
# parts in lower case of which every text that a rule above can match holds at least one
HINTS = ["sk-", "apikey", "api_key", "api-key", "passw", "secret", "token", "key=", "bearer", "_live_", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyj", "private key"]
TAGS = ["system-reminder", "local-command-stdout", "local-command-caveat", "persisted-output", "task-notification", "command-name", "command-message", "command-args"]
NOTE_TAGS = ["system-reminder", "local-command-stdout", "local-command-caveat", "persisted-output", "task-notification", "command-message", "command-args"]
CAVEAT = r"(?m)^Caveat: The messages below.*?$"
CANARIES = [("compact summary", "This session is being continued from a previous"), ("skill body", "Base directory for this skill:"), ("pipeline payload", "[System Instructions]")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_pairs(text: Column, tags: list[str] = TAGS, filler: str = " ") -> Column:
    """Each tag's blocks, from an opener to the first closer after it, replaced by the filler;
    an opener without closer stays. Linear: the text is split at the closers, and of each piece
    the part from its first opener on goes; a piece without opener keeps its closer."""
    for tag in tags:
        text = _strip_pair(text, f"<{tag}>", f"</{tag}>", filler)
    return text


def _strip_pair(text: Column, opener: str, closer: str, filler: str) -> Column:
    def piece(p: Column) -> Column:
        cut = F.concat(F.substring_index(p, opener, 1), F.lit(filler))
        return F.when(p.contains(opener), cut).otherwise(F.concat(p, F.lit(closer)))

    def joined(pieces: Column) -> Column:
        ended = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), piece)
        return F.concat(F.array_join(ended, ""), F.element_at(pieces, -1))

    # bound once, as nested copies of the text's expression would grow with every tag
    return bound(text, lambda t: F.when(t.contains(closer), bound(F.split(t, rf"\Q{closer}\E", -1), joined)).otherwise(t))


def strip_text(text: Column) -> Column:
    """Without outer white space."""
    return F.regexp_replace(text, rf"(?U)\A[{WS}]+|[{WS}]+\z", "")


def collapse_blanks(text: Column) -> Column:
    """Runs of blanks to one, three or more line breaks to two, no outer white space."""
    return strip_text(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def redact(text: Column, rules: list[tuple[str, str]] = REDACTIONS) -> Column:
    """Values that look like credentials, masked by rules applied in order. The rules run only
    on texts that hold one of their fixed parts."""

    def masked(t: Column) -> Column:
        for pattern, mask in rules:
            t = F.regexp_replace(t, pattern, mask)
        return t

    return bound(text, lambda t: F.when(_hinted(t), masked(t)).otherwise(t))


def _hinted(text: Column) -> Column:
    """Whether any hint occurs; by way of capitals, so that letters of the same folding agree."""

    def any_of(folded: Column) -> Column:
        out = folded.contains(HINTS[0])
        for hint in HINTS[1:]:
            out = out | folded.contains(hint)
        return out

    return bound(F.lower(F.upper(text)), any_of)


def clean_text(text: Column) -> Column:
    """Injected blocks out, blanks collapsed, credentials masked; null becomes empty."""
    text = F.regexp_replace(strip_pairs(F.coalesce(text, F.lit(""))), CAVEAT, " ")
    return redact(collapse_blanks(text))


def strip_note_tags(text: Column) -> Column:
    """A typed command keeps its name, other injected tags vanish."""
    text = F.regexp_replace(text, r"(?s)<command-name>(.*?)</command-name>", "$1 ")
    return strip_text(F.regexp_replace(strip_pairs(text, NOTE_TAGS, ""), r"\n{3,}", "\n\n"))


def clean_note(text: Column) -> Column:
    """The note reader's cleaning: tags out, then its own masks."""
    return redact(strip_note_tags(text), NOTE_REDACTIONS)


def leaks(text: Column) -> Column:
    """Whether a credential's value is exposed."""

    def matched(t: Column) -> Column:
        out = t.rlike(LEAKS[0])
        for pattern in LEAKS[1:]:
            out = out | t.rlike(pattern)
        return out

    return F.coalesce(bound(text, lambda t: _hinted(t) & matched(t)), F.lit(False))


def leak_hits(text: Column) -> Column:
    """Numbers (from 1) of the leak rules that match."""
    hits = F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in enumerate(LEAKS, 1)])
    return F.array_compact(hits)


def marker_hits(text: Column) -> Column:
    """How many of the review markers occur."""
    return sum([F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in MARKERS[1:]], F.coalesce(text.rlike(MARKERS[0]), F.lit(False)).cast("int"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def like_ascii(text: Column, part: str, wildcards: bool = False) -> Column:
    """Whether the text contains the part, ignoring the case of ASCII letters only. With
    wildcards, % and _ in the part act as in LIKE; by default they are plain characters."""
    part = part.translate(str.maketrans(_UPPER, _LOWER))
    if wildcards:
        return ascii_lower(text).like("%" + part.replace("\\", "\\\\") + "%")
    return ascii_lower(text).contains(part)


def snippet(text: Column, terms: list[str], width: int = 150) -> Column:
    """Part of the text around the first hit of any term."""
    low = F.lower(text)
    places = [F.when(F.locate(t.lower(), low) > 0, F.locate(t.lower(), low) - 1) for t in terms]
    at = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(0)) if places else F.lit(0)
    start = F.greatest(at - width // 3, F.lit(0))
    body = strip_text(F.replace(F.substring(text, start + 1, F.lit(width)), F.lit("\n"), F.lit(" ⏎ ")))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + width < F.length(text), "…").otherwise(""))


def slugify(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "-")


def project_for(cwd: Column, path: Column, workspace: str | None = None, home: str | None = None) -> Column:
    """A readable project name from the working folder, else from the transcript's folder."""
    scratch = F.regexp_extract(cwd, r"^/(?:private/)?tmp/[a-z]+-\d+/([^/]+)/", 1)
    bare = F.regexp_replace(cwd, "/+$", "")
    name = F.element_at(F.split(bare, "/"), -1)
    out = F.when(F.coalesce(cwd, F.lit("")) == "", F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^-+", "")).when(scratch != "", F.regexp_replace(scratch, "^-+", ""))
    if workspace:
        root = workspace.rstrip("/")
        out = out.when(bare == root, root.rsplit("/", 1)[-1]).when(cwd.startswith(root + "/"), F.element_at(F.split(F.substring(cwd, F.lit(len(root) + 2), F.length(cwd)), "/"), 1))
    if home:
        out = out.when(bare == home.rstrip("/"), "~")
    return out.otherwise(name)


def local_date(iso: Column, zone: str) -> Column:
    """Calendar date of an instant in a zone; ? if missing, its first ten characters if it is
    no instant."""
    local = F.date_format(F.from_utc_timestamp(iso.try_cast("timestamp"), zone), "yyyy-MM-dd")
    return F.when(F.coalesce(iso, F.lit("")) == "", "?").when(is_instant(iso), local).otherwise(F.substring(iso, 1, 10))


def local_stamp(iso: Column, zone: str, width: int = 16) -> Column:
    local = F.substring(F.date_format(F.from_utc_timestamp(iso.try_cast("timestamp"), zone), "yyyy-MM-dd HH:mm:ss"), 1, width)
    return F.when(F.coalesce(iso, F.lit("")) == "", "").when(is_instant(iso), local).otherwise(F.substring(iso, 1, width))


def epoch_seconds(iso: Column) -> Column:
    """Seconds since 1970 of an instant, null for other texts."""
    return F.when(is_instant(iso), F.unix_micros(iso.try_cast("timestamp")) / 1e6)


def age_days(iso: Column, as_of: float, missing: float = 365.0) -> Column:
    """Days before the moment as_of (epoch seconds), never negative."""
    days = (F.lit(as_of) - epoch_seconds(iso)) / 86400.0
    return F.when(days.isNull(), missing).otherwise(F.greatest(days, F.lit(0.0)))


def age_bucket(seconds: Column) -> Column:
    """An age in words: minutes below one hour, hours below 48, else days."""
    hours = seconds / 3600.0
    return F.when(hours < 1, F.concat(F.round(seconds / 60).cast("bigint").cast("string"), F.lit(" min"))).when(hours < 48, F.concat(F.round(hours).cast("bigint").cast("string"), F.lit(" h"))).otherwise(F.concat(F.round(hours / 24).cast("bigint").cast("string"), F.lit(" d")))


def shorten(text: Column, n: int) -> Column:
    """At most n characters, with the number of those left out."""
    bare = strip_text(text)
    return F.when(F.length(bare) <= n, bare).otherwise(F.concat(F.substring(bare, 1, n), F.lit(" ...[+"), (F.length(bare) - n).cast("string"), F.lit(" chars]")))


def short_id(session_id: Column) -> Column:
    return F.substring_index(session_id, "-", 1)
