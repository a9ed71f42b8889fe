"""Text functions: cleaning, WordPiece tokenising, identities and messages."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ranges of ideographs that are tokens of their own, special tokens, and limits of the tokenizer.
IDEOGRAPHS = (r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}"
              r"\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}")
PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
#: What cleaning drops, white space that separates words kept.
DROPPED = r"[\x{0}\x{FFFD}\p{Cc}\p{Cf}&&[^\t\n\r]]"
#: Words, punctuation characters and ideographs of a cleaned text. The letters of Latin-1 come first, one by one: Java looks them
#: up in a table, and tries the ranges and properties that follow only for what isn't among them.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalnum())
WORDS = rf"[[{LETTERS}][^\s\p{{Zs}}{IDEOGRAPHS}{PUNCTUATION}]]+|[{PUNCTUATION}]|[{IDEOGRAPHS}]"
PAD, UNKNOWN, START, END = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
CONTEXT, LONGEST_WORD = 52, 200
WHITE = "\t\n\x0b\x0c\r \x85\xa0"


def clean(text: Column) -> Column:
    """Drops NUL, the replacement character, control and format characters; white space becomes a space."""
    t = F.regexp_replace(text, r"[\t\n\r\p{Zs}]", " ")
    return F.regexp_replace(t, r"[\x{0}\x{FFFD}\p{Cc}\p{Cf}]", "")


def spaced_ideographs(text: Column) -> Column:
    return F.regexp_replace(text, f"([{IDEOGRAPHS}])", " $1 ")


def white_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


@lru_cache(maxsize=1)
def _marks() -> dict[int, None]:
    return dict.fromkeys(c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn")


def strip_accents_of(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFD", text).translate(_marks())


@lru_cache(maxsize=2)
def _accents(lower: bool = False) -> tuple[str, str, str]:
    """(characters, what each of the first becomes, the others being dropped; a pattern of the rest): which characters decompose
    to one or none without accents, and those that Spark's translate can't do: more than one, or marks that stay and may change places.
    lower: of lower-cased characters; a capital sigma, which depends on its place in a word, is in neither."""
    one, gone, odd = {}, [], set()
    for c in map(chr, range(sys.maxunicode + 1)):
        x = c.lower() if lower else c
        if 0xD800 <= ord(c) < 0xE000 or lower and c == "Σ" or x == c and not (
                unicodedata.decomposition(c) or unicodedata.combining(c) or 0xAC00 <= ord(c) < 0xD7A4 or unicodedata.category(c) == "Mn"):
            continue
        t = strip_accents_of(x)
        if not t:
            gone.append(c)
        elif len(t) > 1 or unicodedata.combining(c):
            odd.add(c)
        elif t != c:
            one[c] = t
    odd |= {c for c in map(chr, range(0x250, sys.maxunicode + 1)) if not odd.isdisjoint(c.lower())}
    spans = []
    for c in sorted(map(ord, odd)):
        spans = [*spans[:-1], (spans[-1][0], c)] if spans and spans[-1][1] == c - 1 else [*spans, (c, c)]
    several = "".join(rf"\x{{{a:X}}}-\x{{{z:X}}}" for a, z in spans)
    return "".join([*one, *gone]), "".join(one.values()), rf"[[^\x{{0}}-\x{{24F}}]&&[{several}]]"


@lru_cache(maxsize=1)
def _folded() -> tuple[str, str, str]:
    """For basic_tokens: (characters, what each of the first becomes, the others being dropped) by cleaning, lower-casing and without
    accents; a pattern of those that this doesn't settle: several characters, capital sigma, and from U+0250 on what is dropped
    or what Java, whose tables differ from Python's, doesn't know."""
    characters, become, several = _accents(lower=True)
    dropped = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c) in ("Cc", "Cf") and c not in "\t\n\r")
    return characters + dropped, become, several.replace("&&[", r"&&[Σ\x{FFFD}\p{C}")


@F.pandas_udf(StringType())
def _strip_accents(text: pd.Series) -> pd.Series:  # Spark has no decomposition of characters
    return text.map(strip_accents_of, na_action="ignore")


def strip_accents(text: Column, of: Column | None = None) -> Column:
    """Characters are mapped by Spark; only texts with one that becomes several go to a Python worker. of: the column that
    `text` is made from without adding characters, but by lower-casing, if it costs less to look at."""
    of = text if of is None else of
    characters, become, several = _accents()
    plain = F.octet_length(of) == F.length(of)
    by_python = _strip_accents(F.when(~plain & of.rlike(several), text))
    return F.when(plain, text).otherwise(F.coalesce(by_python, F.translate(text, characters, become)))


def split_punctuation(word: Column) -> Column:
    """Array: each punctuation character alone, and what stands between."""
    return F.regexp_extract_all(word, F.lit(f"[{PUNCTUATION}]|[^{PUNCTUATION}]+"), F.lit(0))


def basic_tokens(text: Column) -> Column:
    """Lower-case words and punctuation characters, without accents; ideographs are words of their own. As clean(), spaced
    ideographs, lower case, strip_accents(), white_tokens() and split_punctuation() one after another, but characters are mapped
    once and matched once. Only texts with one that has no such mapping take these steps, in two passes."""
    characters, become, unsettled = _folded()
    mapped = F.translate(text, characters, become)
    settled = (F.octet_length(mapped) == F.length(mapped)) | ~text.rlike(unsettled)
    stepwise = strip_accents(F.lower(F.regexp_replace(text, DROPPED, "")), text)
    return F.regexp_extract_all(F.when(settled, mapped).otherwise(stepwise), F.lit(WORDS), F.lit(0))


def pieces_of(word: str, vocab: dict[str, int], longest: int = LONGEST_WORD) -> list[str]:
    """Greedy longest matches, continuations marked ##; one unknown token for long words and those that can't be matched."""
    if len(word) > longest:
        return [UNKNOWN]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            p = word[at:end] if at == 0 else "##" + word[at:end]
            if p in vocab:
                break
        else:
            return [UNKNOWN]
        out.append(p)
        at = end
    return out


def load_vocabulary(lines: list[str]) -> dict[str, int]:
    """One token a line, numbered among the lines that aren't empty; the four special tokens must be there."""
    kept = [x.rstrip("\r\n") for x in lines]
    vocab = {t: i for i, t in enumerate(x for x in kept if x)}
    missing = [t for t in (PAD, UNKNOWN, START, END) if t not in vocab]
    if missing:
        raise ValueError(f"vocabulary lacks {missing}")
    return vocab


def wordpiece(df: DataFrame, tokens_col: str, vocab: dict[str, int], out: str = "ids", context: int = CONTEXT) -> DataFrame:
    """Adds ids: start, at most context - 2 ids of word pieces, end, padding. The vocabulary is broadcast: its size is fixed.

    As every token that isn't empty gives an id, no more than the first context - 2 of them go to Python, and of a long one no
    more than tells that it is too long: what a worker holds doesn't grow with the texts."""
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    known: dict[str, list[int]] = {}

    @F.arrow_udf("array<long>")
    def ids_of(lists: pa.Array) -> pa.Array:
        v, rows = shared.value, []
        for tokens in lists.to_pylist():
            ids: list[int] = []
            for t in tokens or ():
                if len(ids) >= context - 2:
                    break
                if t not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[t] = [v.get(p, v[UNKNOWN]) for p in pieces_of(t, v)]
                ids += known[t]
            ids = [v[START], *ids[:context - 2], v[END]]
            rows.append(ids + [v[PAD]] * (context - len(ids)))
        return pa.array(rows, pa.list_(pa.int64()))

    first = F.slice(F.filter(F.col(tokens_col), lambda t: t != ""), 1, context - 2)
    return df.withColumn(out, ids_of(F.transform(first, lambda t: F.left(t, F.lit(LONGEST_WORD + 1)))))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")


def identity(asset_id: Column, payload: Column) -> Column:
    """The trimmed id; for none, asset- and 16 hex digits of the payload's SHA-256."""
    return F.coalesce(F.nullif(trimmed(asset_id), F.lit("")), F.concat(F.lit("asset-"), F.left(F.sha2(payload, 256), F.lit(16))))


def short_id(asset_id: Column, n: int, missing: str | None = None) -> Column:
    short = F.left(asset_id, F.lit(n))
    return F.coalesce(short, F.lit(missing)) if missing is not None else short


def is_backed(library_id: Column) -> Column:
    return F.coalesce(F.length(library_id) > 0, F.lit(False))


def title(file_name: Column, created: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(file_name, F.lit("")), F.date_format(created, "yyyy-MM-dd HH:mm"), F.lit(fallback))


def token_texts(ids: Column, vocab: dict[str, int]) -> Column:
    """The tokens of ids; unknown for ids that the vocabulary lacks. The vocabulary is broadcast once, not part of the plan."""
    names = SparkSession.active().sparkContext.broadcast({i: t for t, i in vocab.items()})

    @F.pandas_udf("array<string>")
    def texts(own: pd.Series) -> pd.Series:
        return own.map(lambda some: None if some is None else [names.value.get(i, UNKNOWN) for i in some])

    return texts(ids)


def resource_fingerprint(name: Column, size: Column, modified: Column) -> Column:
    """name:size:mtime of each resource of an aggregation, in the order of names, joined by a bar."""
    return F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", name, size.cast("string"), modified.cast("string")))), "|")
