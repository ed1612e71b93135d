"""Text cleaners, tokens, n-grams and shortening as column expressions. Each analysis has its own cleaner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL, MENTION, HASHTAG, RULE = r"https?://[^ \t\n\r]+|www\.[^ \t\n\r]+", r"@[A-Za-z0-9_]+", r"#([A-Za-z0-9_]+)", r"([ \t\n\r]*---)+[ \t\n\r]*$"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"
SPACE = r"[ \t\n\r\f\x{0B}]+"

STOP_WORDS = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own said same says she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)


def _sub(text: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def for_sentiment(text: Column) -> Column:
    """Links, emoji and closing rules go, white space becomes single."""
    return squeeze(_sub(text, (URL, ""), (EMOJI, ""), (RULE, "")))


def for_framing(text: Column) -> Column:
    """As for sentiment, but each becomes a space."""
    return squeeze(_sub(text, (URL, " "), (EMOJI, " "), (RULE, " ")))


def for_topics(text: Column) -> Column:
    """Links, rules, emoji and mentions go; lower case; bullets before and dashes around go."""
    plain = F.lower(_sub(text, (URL, " "), (RULE, " "), (EMOJI, " "), (MENTION, " ")))
    return F.btrim(squeeze(F.regexp_replace(plain, r"^[ \t\n\r•*·-]+", "")), F.lit(" -–—•:|"))


def for_entities(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, MENTION, " "))


def for_comparison(text: Column) -> Column:
    """Lower-case words of letters and hyphens; hashtags aren't opened."""
    return squeeze(F.regexp_replace(F.lower(_sub(text, (URL, " "), (MENTION, " "), (RULE, " "))), r"[^a-z \t\n\r-]", " "))


def _lexical_parts(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(_sub(text, (URL, " "), (MENTION, " "), (HASHTAG, " $1 "), (RULE, " "))), r"[^a-z \t\n\r-]", " ")
    return F.split(plain, r"[ \t\n\r]+")


def lexical_tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS, least: int = 3) -> Column:
    """Words of a message for TF-IDF: hashtags are opened, hyphens at the ends go, short and stop words too."""
    words = F.transform(_lexical_parts(text), lambda w: F.btrim(w, F.lit("-")))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def phrase_tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS, least: int = 3, keep: tuple[str, ...] = ("us", "un", "eu", "uk"), clip: int | None = None) -> Column:
    """Words of a message for phrases, in order; ``keep`` are kept although short. ``clip`` cuts the text first."""
    text = F.left(text, F.lit(clip)) if clip else text
    plain = _sub(text, (URL, " "), (MENTION, " "), (HASHTAG, " "), (RULE, " "), ("’", "'"), ("[-/_]", " "))
    plain = F.regexp_replace(F.lower(plain), r"[^a-z \t\n\r']", " ")
    words = F.transform(F.split(plain, r"[ \t\n\r]+"), lambda w: F.btrim(w, F.lit("'")))
    return F.filter(words, lambda w: w.isin(*keep) | ((F.length(w) >= least) & ~w.isin(*stop)))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, as strings; empty if it is shorter."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*(F.slice(tokens, k + 1, count).alias(f"w{k}") for k in range(n)))
    return F.transform(shifted, lambda x: F.concat_ws(" ", *(x[f"w{k}"] for k in range(n))))


def shorten(text: Column, width: int, blank: str = "(media-only message)") -> Column:
    """White space collapsed; cut at a word so that the text with ``...`` fits; ``blank`` where there is none."""
    line = squeeze(F.coalesce(text, F.lit("")))
    cut = F.concat(F.rtrim(F.regexp_extract(line, rf"^(.{{0,{width - 3}}})(?= )", 1)), F.lit("..."))
    return F.when(line == "", blank).when(F.length(line) <= width, line).otherwise(cut)


def clip_middle(text: Column, most: int) -> Column:
    """A long text's head and tail around a line break, ``most`` characters in all."""
    head = most // 2
    tail = most - head - 1
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(head))), F.lit("\n"), F.ltrim(F.right(text, F.lit(tail))))).otherwise(text)


def probably_english(text: Column) -> Column:
    """Not blank, without letters of some other scripts, and of its letters nine in ten ASCII (or no letters)."""
    text = F.coalesce(text, F.lit(""))
    other = text.rlike(r"[\x{0400}-\x{04FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0900}-\x{097F}\x{4E00}-\x{9FFF}]")
    ascii_, letters = F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (F.trim(text) != "") & ~other & ((letters == 0) | (ascii_ / F.nullif(letters, F.lit(0)) >= 0.9))


def normal_entity(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """An entity's name without punctuation around it and with its alias applied."""
    plain = squeeze(F.regexp_replace(F.btrim(name, F.lit(" \t\n.,;:!?\"'()[]{}<>«»“”‘’")), "’", "'"))
    for pattern, value in {"(?i)^(u\\.?s\\.?(a\\.?)?|united states( of america)?|america)$": "United States", "(?i)^(u\\.?n\\.?|united nations)$": "United Nations"}.items():
        plain = F.when(plain.rlike(pattern), value).otherwise(plain)
    for alias, value in (aliases or {}).items():
        plain = F.when(F.lower(plain) == alias.lower(), value).otherwise(plain)
    return plain


def slugify(text: Column, fallback: str = "item") -> Column:
    """Lower-case letters and digits joined by hyphens; common accents fall away."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit(fallback))


def split_csv(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def lexical_tokens_sql(text: str = "text", least: int = 3) -> str:
    plain = f"regexp_replace(regexp_replace(regexp_replace({text}, '{URL}', ' ', 'g'), '{MENTION}', ' ', 'g'), '{HASHTAG}', ' \\1 ', 'g')"
    plain = f"regexp_replace(lower(regexp_replace({plain}, '{RULE}', ' ', 'g')), '[^a-z \\t\\n\\r-]', ' ', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({plain}, '[ \\t\\n\\r]+'), lambda w: trim(w, '-')), lambda w: length(w) >= {least} AND w NOT IN ({_STOP_SQL}))"


def phrase_tokens_sql(text: str = "text", least: int = 3) -> str:
    plain = text
    for rule in (URL, MENTION, HASHTAG, RULE):
        plain = f"regexp_replace({plain}, '{rule}', ' ', 'g')"
    plain = f"regexp_replace(lower(regexp_replace(replace({plain}, '’', ''''), '[-/_]', ' ', 'g')), '[^a-z \\t\\n\\r'']', ' ', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({plain}, '[ \\t\\n\\r]+'), lambda w: trim(w, '''')), lambda w: w IN ('us', 'un', 'eu', 'uk') OR (length(w) >= {least} AND w NOT IN ({_STOP_SQL})))"
