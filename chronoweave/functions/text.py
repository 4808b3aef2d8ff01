"""Word and token functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed word lists.
MODALS = ["would", "could", "might", "may", "should", "'d", "will"]
WH_WORDS = ["who", "what", "when", "where", "why", "which", "how", "whom", "whose"]
PERSONS = ["i", "you", "he", "she", "we", "they", "me", "him", "her", "us", "them", "himself", "herself", "themselves", "myself", "yourself", "ourselves"]
INANIMATE = ["it", "itself", "its", "this", "that", "these", "those"]
PERSON_NOUNS = ["man", "woman", "men", "women", "person", "people", "boy", "girl"]
ABSTRACT_PERSONS = ["nobody", "noone", "someone", "somebody", "anyone", "anybody"]
POINTERS = ["that", "this", "those", "these", "the"]
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
DETERMINERS = ["the", "a", "an", "these", "those"]


def is_modal(word: Column) -> Column:
    return F.lower(word).isin(*MODALS)


def is_wh(word: Column) -> Column:
    return F.lower(word).isin(*WH_WORDS)


def is_person_word(word: Column) -> Column:
    return F.lower(word).isin(*PERSONS)


def is_inanimate_word(word: Column) -> Column:
    return F.lower(word).isin(*INANIMATE)


def is_person_noun(word: Column) -> Column:
    return F.lower(word).isin(*PERSON_NOUNS)


def is_abstract_person(word: Column) -> Column:
    return F.lower(word).isin(*ABSTRACT_PERSONS)


def is_object_reference(word: Column) -> Column:
    return F.lower(word).isin(*POINTERS)


def is_number(word: Column) -> Column:
    return F.lower(word).isin(*NUMBERS) | F.regexp_like(word, F.lit(r"^[\d\s.\-/\\]+$"))


def is_capitalised(word: Column) -> Column:
    return F.regexp_like(word, F.lit("^[A-Z]"))


def without_determiner(phrase: Column) -> Column:
    return F.regexp_replace(phrase, rf"(?i)^(?:{'|'.join(DETERMINERS)})\s+", "")


def without_punctuation(word: Column) -> Column:
    """ASCII signs taken off both ends."""
    return F.regexp_replace(word, r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")


def joined(tokens: Column, start: Column, length: Column) -> Column:
    """length tokens from the 1-based place start, with blanks between."""
    return F.concat_ws(" ", F.slice(tokens, start, length))


def stem_of_name(name: Column) -> Column:
    """A document's name up to its first dot."""
    return F.substring_index(name, ".", 1)


def encoded_token(before: Column, token: Column, after: Column) -> Column:
    """The triple as quoted strings, quotes and backslashes escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))
    return F.concat_ws(" ", quoted(before), quoted(token), quoted(after))


def decoded_token(text: Column) -> Column:
    """Struct before, token, after of encoded_token()."""
    parts = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    plain = F.transform(parts, lambda p: F.regexp_replace(p, r"\\(.)", "$1"))
    return F.struct(F.get(plain, F.lit(0)).alias("before"), F.get(plain, F.lit(1)).alias("token"), F.get(plain, F.lit(2)).alias("after"))


def grammatical_group(relation: Column) -> Column:
    """A dependency's coarse name."""
    return (
        F.when(F.regexp_like(relation, F.lit("^conj")), "conj").when(F.regexp_like(relation, F.lit("comp$")), "comp").when(F.regexp_like(relation, F.lit("mod$")), "mod")
        .when(F.regexp_like(relation, F.lit("subj(pass)?$")) | (relation == "agent"), "subj").when(F.regexp_like(relation, F.lit("obj$")), "obj").otherwise(relation)
    )


def is_event_tag(tag: Column) -> Column:
    """Tags that a token needs to be an event."""
    return F.regexp_like(F.upper(tag), F.lit("^(NN|VB|J)")) | F.upper(tag).isin("IN", "RP")


def trailing_space(text: Column) -> Column:
    """The white space at the end of a text."""
    return F.regexp_extract(text, r"(\s*)$", 1)


def shown(values: Column, n: int) -> Column:
    """The first n values of an array with blanks between."""
    return F.array_join(F.slice(values, 1, n), " ")
