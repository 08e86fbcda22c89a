"""Column functions over text. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that a browser's \s matches, and the zero-width characters removed beside it.
SPACES = r"\x{9}-\x{d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
ZERO_WIDTH = r"\x{200b}-\x{200d}\x{2060}"

# Colour words in the order in which they are looked for, with what they are shown as.
COLOURS = [("green", "#57cc99"), ("red", "#ff6b6b"), ("amber", "#f9c74f"), ("yellow", "#f9c74f"), ("orange", "#f9c74f"), ("blue", "#4cc9f0"), ("white", "#e8eef5"), ("infra", "#6b4bd6")]
NEUTRAL = "#8ea0b5"

ELLIPSIS = "…"
#: Everything from an opening tag to its closing one, or to the end where that is missing, with the white space after it.
THINKING = r"(?s)\A\s+|<think>.*?(?:</think>|\z)\s*"


def trim_spaces(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"\A[{SPACES}]+|[{SPACES}]+\z", "")


def remove_invisible(c: Column) -> Column:
    """Without white space and zero-width characters anywhere."""
    return F.regexp_replace(c, f"[{SPACES}{ZERO_WIDTH}]", "")


def strip_slashes(c: Column) -> Column:
    """Trimmed and without slashes at the end; null gives ''."""
    return F.regexp_replace(trim_spaces(F.coalesce(c, F.lit(""))), "/+$", "")


def first_text(*cs: Column | str) -> Column:
    """The first that is neither null nor ''. A str is a literal."""
    return F.coalesce(*[F.lit(c) if isinstance(c, str) else F.nullif(c, F.lit("")) for c in cs])


def first_value(*cs: Column | str) -> Column:
    """The first that isn't null; '' counts as a value. A str is a literal."""
    return F.coalesce(*[F.lit(c) if isinstance(c, str) else c for c in cs])


def empty_to_null(c: Column) -> Column:
    """F8: null for ''."""
    return F.nullif(c, F.lit(""))


def join_present(separator: str, *cs: Column) -> Column:
    """Those that are neither null nor '', joined."""
    return F.concat_ws(separator, *[empty_to_null(c) for c in cs])


def truncate_label(c: Column, n: int) -> Column:
    """At most n characters (code points), the last an ellipsis where something is cut off."""
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(F.substring(c, 1, n - 1), rf"[{SPACES}]+\z", ""), F.lit(ELLIPSIS))).otherwise(c)


def wrap_label(c: Column, per_line: int = 19, most_lines: int = 2) -> Column:
    """Array of at most ``most_lines`` lines, broken between words; what doesn't fit is marked by an ellipsis. A longer word keeps its line."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(False).alias("full"))

    def add(acc: Column, word: Column) -> Column:
        wider = F.when(acc["line"] == "", word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        lines = F.when(acc["line"] == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"])))
        fits = F.length(wider) <= per_line
        broken = F.struct(lines.alias("lines"), word.alias("line"), (F.size(lines) >= most_lines).alias("full"))
        kept = F.struct(acc["lines"].alias("lines"), wider.alias("line"), F.lit(False).alias("full"))
        return F.when(acc["full"], acc).when(fits, kept).otherwise(broken)

    def finish(acc: Column) -> Column:
        rest = (acc["line"] != "") & (F.size(acc["lines"]) < most_lines)
        lines = F.when(rest, F.concat(acc["lines"], F.array(acc["line"]))).otherwise(acc["lines"])
        last = F.element_at(lines, -1)
        marked = F.concat(F.regexp_replace(F.substring(last, 1, per_line - 1), rf"[{SPACES}]+\z", ""), F.lit(ELLIPSIS))
        cut = (F.size(lines) > 0) & (F.length(F.array_join(lines, " ")) < F.length(c))
        return F.when(cut, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(marked))).otherwise(lines)

    # Lines are full after so many words; what follows may stay in one piece.
    most_words = most_lines * ((per_line + 1) // 2) + 4
    return F.when(c.isNotNull(), F.aggregate(F.split(c, f"[{SPACES}]+", most_words), start, add, finish))


def colour_of(c: Column) -> Column:
    """How an indicator's colour is shown; the order of the words decides, so 'infrared' is red."""
    low = F.lower(F.coalesce(c, F.lit("")))
    shown = reduce(lambda acc, w: acc.when(low.contains(w[0]), F.lit(w[1])), COLOURS[1:], F.when(low.contains(COLOURS[0][0]), F.lit(COLOURS[0][1])))
    return shown.otherwise(F.lit(NEUTRAL))


def human_bytes(c: Column) -> Column:
    """Bytes, whole kilobytes, or megabytes with one decimal; halves round up."""
    tenths = F.floor(c / (1 << 20) * 10 + 0.5).cast("long")
    mega = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(" MB"))
    kilo = F.concat(F.floor(c / 1024 + 0.5).cast("long").cast("string"), F.lit(" KB"))
    return F.when(c < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B"))).when(c < 1 << 20, kilo).otherwise(mega)


def strip_thinking(c: Column) -> Column:
    """Without <think> blocks and the white space after them, trimmed; an unterminated block goes to the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, THINKING, ""), r"\A\s+|\s+\z", ""))


def relative_date(at: Column, now: Column) -> Column:
    """X11: 'Today', 'Yesterday', 'Mon d' in the same year, else 'Mon d, yyyy'; then the time. Both are timestamps in the session's zone."""
    day, today = F.to_date(at), F.to_date(now)
    date = F.when(day == today, F.lit("Today")).when(day == F.date_sub(today, 1), F.lit("Yesterday")).when(F.year(at) == F.year(now), F.date_format(at, "MMM d")).otherwise(F.date_format(at, "MMM d, yyyy"))
    return F.concat(date, F.lit(", "), F.date_format(at, "h:mm a"))


def split_list(c: Column, separators: str = f"[{SPACES},]+") -> Column:
    """The non-empty items of a list in text, trimmed. Null gives no items."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separators), trim_spaces), lambda x: x != "")


def prompt_with_hint(prompt: str, hint: Column) -> Column:
    """The prompt, and the trimmed hint in a paragraph of its own if there is one."""
    clean = trim_spaces(F.coalesce(hint, F.lit("")))
    return F.when(clean == "", F.lit(prompt)).otherwise(F.concat(F.lit(prompt + "\n\n"), clean))


def chat_role(c: Column) -> Column:
    """The role 'model' by its other vendor's name."""
    return F.when(c == "model", F.lit("assistant")).otherwise(c)


def data_url(c: Column) -> Column:
    """struct(mime_type, base64) of a data URL, else null."""
    shape = r"(?s)^data:([^;,]+)[^,]*,(.*)$"
    return F.when(c.rlike(shape), F.struct(F.regexp_extract(c, shape, 1).alias("mime_type"), F.regexp_extract(c, shape, 2).alias("base64")))


def number_or(c: Column, default: float = 0) -> Column:
    """M3: a number in text; null gives the default, text that is no number gives null."""
    return F.when(c.isNull(), F.lit(float(default))).otherwise(c.try_cast("double"))
