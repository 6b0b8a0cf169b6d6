"""Text functions on columns. Only ASCII letters change case and only the six ASCII white-space characters separate words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE_RUN = r"[ \t\n\x0B\f\r]+"
BASIC_TOKEN = r"[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~ \t\n\x0B\f\r]+"
URL = r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]*"
URL_TAIL = r"[.,);]+$"
#: A URL is kept if it is longer than this.
URL_BYTES = 10
MOST_PHRASES, LONGEST_WINDOW = 15, 5

# The words that the stop-word filter removes.
STOP_WORDS = (
    "a about after also am an and are at be been before being bro buddy but by can could did do does dude for from "
    "guys had has have having he hello her hey hi him his how i if in into is it its just like man mate may me might must my nah no "
    "not of oh ok okay on or our over please quite really shall she should so thanks that the their them then these they this those "
    "to too uh um very was we well were what when where which who whom why will with would yeah yep yo you your"
).split()

# What surrounds the context of a prompt, and the text that an action leaves in the log.
CONTEXT_INTRO = "Use the following context to answer the question:\n\n<context>"
CONTEXT_OUTRO = "</context>\n\nQuestion: "
ACTION = "Executed local action: "


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def sanitize(text: Column) -> Column:
    """Lower-cased, white space collapsed to one space and trimmed; null stays null."""
    return F.trim(F.regexp_replace(ascii_lower(text), WHITE_RUN, " "))


def words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, WHITE_RUN, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def basic_tokens(text: Column) -> Column:
    """Lower-cased words, with every ASCII punctuation character a token of its own."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(BASIC_TOKEN), F.lit(0))


def without_stop_words(of: Column, stop: list[str] = STOP_WORDS) -> Column:
    """The words that are not exactly a stop word; `please,` is kept."""
    return F.filter(of, lambda w: ~w.isin(*stop))


def extract_urls(text: Column) -> Column:
    """http and https URLs in order, repeats included, without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, URL_TAIL, "")), lambda u: F.octet_length(u) > URL_BYTES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once for each row however often body names it."""
    return F.transform(F.array(value), body)[0]


def windows(of: Column, most: int | None = None) -> Column:
    """Word windows joined by a space, from min(5, n - 1) words down to one, from left to right; none for n of two or less.

    With `most`, at most so many of each size, from the left; `of` should then be bound (see `let`), so that the work does
    not grow with the number of words.
    """
    n = F.size(of)
    sizes = F.sequence(F.least(F.lit(LONGEST_WINDOW), n - 1), F.lit(1), F.lit(-1))
    last = lambda k: n - k if most is None else F.least(n - k, F.lit(most - 1))
    made = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(0), last(k)), lambda i: F.array_join(F.slice(of, i + 1, k), " "))))
    return F.when(n > 2, made).otherwise(F.array().cast("array<string>"))


def phrases(text: Column, most: int = MOST_PHRASES) -> Column:
    """Candidate phrases of a text, in the order in which routing tries them: the text, its words without stop words if
    some but not all are stop words, then the windows; at most `most`. The text is split once, and only the first windows
    are made, so that time is linear in the words."""

    def listed(t: Column, of: Column, kept: Column) -> Column:
        filtered = F.when((F.size(kept) > 0) & (F.size(kept) < F.size(of)), F.array(F.array_join(kept, " "))).otherwise(F.array().cast("array<string>"))
        return F.slice(F.concat(F.array(t), filtered, windows(of, most)), 1, most)

    return let(text, lambda t: let(words(t), lambda of: let(without_stop_words(of), lambda kept: listed(t, of, kept))))


def user_content(text: Column, context: Column) -> Column:
    """The text, under the context if there is any."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(CONTEXT_INTRO), context, F.lit(CONTEXT_OUTRO), text)).otherwise(text)


def action_text(intent: Column) -> Column:
    return F.concat(F.lit(ACTION), intent)


def action_line(intent: Column, score: Column) -> Column:
    return F.format_string("[ACTION] %s (score: %s)", intent, score.cast("string"))


def short_label(name: Column, most: int = 42) -> Column:
    bare = F.replace(name, F.lit("ACTION_"), F.lit(""))
    return F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("…"))).otherwise(bare)


def is_ort_model(path: Column) -> Column:
    return F.endswith(path, F.lit(".ort"))
