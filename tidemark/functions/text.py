"""Text expressions: counts, cleaning, links, chunks, digests. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

URL, MENTION, HASHTAG = r"https?://\S+|www\.\S+", r"(?U)@\w+", r"(?U)#\w+"
ID11 = "([a-zA-Z0-9_-]{11})"
#: How a link to another video looks, in the order of preference.
LINKS = [rf"(?:https?://)?(?:www\.)?youtube\.com/watch\?v={ID11}", rf"(?:https?://)?youtu\.be/{ID11}", rf"(?:https?://)?(?:www\.)?youtube\.com/shorts/{ID11}"]
WHITE = "[ \\t\\n\\r\\f\\x0b]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, even if body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words; none for null and blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WHITE}+"), lambda w: w != "")


def comment_features(text: Column) -> dict[str, Column]:
    """Counts of one comment; the emoji features are in emoji_features."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f\x0b"))
    w = words(t)
    n = F.size(w)
    chars = F.aggregate(w, F.lit(0), lambda a, x: a + F.char_length(x))
    return {
        "text_length": F.char_length(t).cast("long"), "word_count": n.cast("long"), "url_count": count_of(t, URL).cast("long"), "mention_count": count_of(t, MENTION).cast("long"), "hashtag_count": count_of(t, HASHTAG).cast("long"),
        "exclamation_count": count_of(t, "!").cast("long"), "question_count": count_of(t, r"\?").cast("long"), "avg_word_length": F.when(n > 0, chars / n).otherwise(0.0),
        "has_numbers": t.rlike(r"[0-9]").cast("int"), "has_links": (count_of(t, URL) > 0).cast("int"),
    }


def emoji_features(found: Column, n_words: Column) -> dict[str, Column]:
    """found: the text's emoji units. Entropy in nats over distinct units."""
    n = F.size(found)
    kinds = F.array_distinct(found)
    share = lambda k: F.size(F.filter(found, lambda x: x == k)) / n
    ent = F.aggregate(kinds, F.lit(0.0), lambda a, k: a - share(k) * F.ln(share(k)))
    return {"emoji_count": n.cast("long"), "unique_emoji_count": F.size(kinds).cast("long"), "emoji_entropy": F.when(n > 0, ent).otherwise(0.0), "emoji_variety_ratio": F.when(n > 0, F.size(kinds) / n).otherwise(0.0), "emoji_per_word_ratio": F.when((n > 0) & (n_words > 0), n / n_words).otherwise(0.0)}


#: What some emoji stand for.
EMOJI_TAXONOMY = {
    "love": ["❤️", "💕", "💖", "😍", "🥰", "💗", "💝", "💞", "👍", "💯"],
    "celebration": ["🎉", "🎊", "🥳", "🎈", "✨", "⭐", "🌟", "🔥", "👏", "🙌"],
    "humor": ["😂", "🤣", "😄", "😁", "😆", "🤪", "😜", "🤩", "😏", "💀"],
    "inquiry": ["❓", "❔", "🤔", "🧐", "😕", "🤨", "💭", "🙄", "😐", "😒"],
}


def emoji_table() -> dict[str, str]:
    """Each emoji's category."""
    return {e: name for name, all_ in EMOJI_TAXONOMY.items() for e in all_}


def categories(found: Column, table: dict[str, str], other: str = "other") -> Column:
    """Emoji units by category: a map of counts."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    named = F.transform(found, lambda u: F.coalesce(F.try_element_at(lookup, u), F.lit(other)))
    return F.map_from_entries(F.transform(F.array_distinct(named), lambda k: F.struct(k, F.size(F.filter(named, lambda x: x == k)))))


def composed(text: Column, emoji_names: bool = False) -> Column:
    """Unicode's composed form, and with emoji_names each emoji as :its_name:. Both go through Python in Arrow batches."""
    from . import emoji

    return emoji.with_names(emoji.composed(text)) if emoji_names else emoji.composed(text)


def social_clean(text: Column) -> Column:
    """Links and mentions become marks, #x becomes x, runs of three or more of a character become two, white space one space. For decomposed letters see composed()."""
    # The patterns and marks.
    steps = [(r"https?://\S+|www\.\S+", "[URL]"), (r"(?U)@\w+", "[UTENTE]"), (r"(?U)#(\w+)", "$1"), (r"(.)\1{2,}", "$1$1"), (r"\s+", " ")]
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text))


def plain(text: Column) -> Column:
    """Links and emoji out, white space one space."""
    c = F.regexp_replace(F.regexp_replace(text, URL, ""), r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0E}\x{FE0F}\x{200D}]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_transcript(text: Column) -> Column:
    """Captions as one line: header, time codes, cue numbers and tags go."""
    # The patterns.
    steps = [
        (r"\r\n?", "\n"), (r"(?im)^WEBVTT.*$", ""), (r"\d{1,2}:\d{2}:\d{2}[.,]\d+\s*-->\s*\d{1,2}:\d{2}:\d{2}[.,]\d+", ""), (r"\d{1,2}:\d{2}[.,]\d+\s*-->\s*\d{1,2}:\d{2}[.,]\d+", ""),
        (r"\b\d{1,2}:\d{2}(?::\d{2})?[.,]\d+\b", ""), (r"(?m)^\s*\d+\s*$", ""), (r"<[^>]+>", ""), (r"\s+", " "),
    ]
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, F.coalesce(text, F.lit(""))))


def normal_hash(text: Column) -> Column:
    """sha256 of the text in lower case with single spaces: equal for texts that read the same."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), f"{WHITE}+", " ")), 256)


def token_estimate(text: Column) -> Column:
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def chunks(text: Column, size: int = 1440, overlap: int = 120) -> Column:
    """Array of chunks of `size` words that start every size - overlap words; a blank text has none."""
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size - overlap))
    return let(words(text), lambda w: F.when(F.size(w) > 0, F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, size), " "))))


def links(text: Column, own: Column | None = None) -> Column:
    """Ids of linked videos: by pattern, then place; distinct; without one's own."""
    t = F.coalesce(text, F.lit(""))
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in LINKS]))
    return found if own is None else F.filter(found, lambda x: ~x.eqNullSafe(own))


def link_target(href: Column) -> Column:
    """struct(kind, id) of an overlay's link: long for /watch, short for /shorts, nulls for others."""
    h = F.coalesce(href, F.lit(""))
    long, short = F.nullif(F.regexp_extract(h, rf"/watch\?v={ID11}", 1), F.lit("")), F.nullif(F.regexp_extract(h, rf"/shorts/{ID11}", 1), F.lit(""))
    return F.struct(F.when(long.isNotNull(), "long").when(short.isNotNull(), "short").alias("kind"), F.coalesce(long, short).alias("id"))


def connection(own: Column, overlay: Column, described: Column) -> Column:
    """struct(status, connection_type, connected_id, detection_method): an overlay to another video, else the description's first link, else none."""
    over = overlay["id"].isNotNull() & (overlay["id"] != own)
    first = F.get(described, F.lit(0))
    some = over | first.isNotNull()
    return F.struct(
        F.when(some, "connected").otherwise("no_connection").alias("status"), F.when(over, overlay["kind"]).when(first.isNotNull(), "long").otherwise("none").alias("connection_type"),
        F.when(over, overlay["id"]).otherwise(first).alias("connected_id"), F.when(over, "overlay_link").when(first.isNotNull(), "description").otherwise("not_found").alias("detection_method"),
    )


def iso_seconds(duration: Column) -> Column:
    """PT#H#M#S in seconds, null if it isn't one."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(duration, rf"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?", unit), F.lit("")), F.lit("999999999")), F.lit(0)).cast("long")
    return F.when(duration.rlike("^PT"), part(1) * 3600 + part(2) * 60 + part(3))


def shortcode(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/(?:p|reel|tv)/([A-Za-z0-9_-]+)", 1), F.lit(""))


def sponsored(text: Column) -> Column:
    # The words that tell it.
    return F.lower(F.coalesce(text, F.lit(""))).rlike(r"#ad\b|sponsor|#adv\b|in collaborazione con|paid partnership")


def needs_check(text: Column, confidence: Column, pattern: str, least: float = 0.75) -> Column:
    """Whether a label is to be looked at again: low confidence, or a keyword in the text."""
    return (confidence < least) | F.coalesce(text.rlike(pattern), F.lit(False))


def without_fences(text: Column, limit: int | None = None) -> Column:
    """An answer without the marks of a code block around it; limit: its first characters, where the caller's feature is a preview."""
    c = F.regexp_replace(F.regexp_replace(F.btrim(text, F.lit(" \t\n\r\f\x0b")), r"^```json\s*", ""), r"\s*```$", "")
    c = F.btrim(c, F.lit(" \t\n\r\f\x0b"))
    return c if limit is None else F.left(c, F.lit(limit))


def label_key(label: Column) -> Column:
    """Letters a-z and digits of a label, in lower case: labels that differ in signs and spaces alone are equal."""
    return F.regexp_replace(F.lower(label), "[^a-z0-9]", "")


def comment_flags(text: Column) -> dict[str, Column]:
    """The comment without links, and without emoji; whether it begins with a mention; whether Latin letters meet characters beyond ASCII."""
    t = F.coalesce(text, F.lit(""))
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(t, URL, ""), r"\s+", " "))
    return {"text_cleaned": cleaned, "text_no_emoji": plain(t), "is_reply_text": t.rlike(r"(?U)^\s*@\w+"), "has_multiple_scripts": cleaned.rlike("[a-zA-Z]") & cleaned.rlike(r"[^\x00-\x7F]")}


def match_words(text: Column) -> Column:
    """Lower-case words without the marks , . ? ! - ' \" >> <<"""
    return words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[,.?!'\"-]|>>|<<", " "))
