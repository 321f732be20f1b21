"""Token counts per section or field, by offsets of one encoding of the whole document.

A document is encoded once, as a whole: tokens at a boundary are the ones the model will see, which they would not be if
the parts were encoded one by one. The tokenizer is a byte-level vocabulary, so the byte length of each id gives every
token's span; a sorted interval join (tokens and sections of the same row, both in order) finds the sections a token
touches. A token that crosses a boundary is allocated by rule:

* ``start``: to the section that holds its first byte;
* ``most``: to the section that holds most of its bytes, the earlier one if equal;
* ``split``: to all of them, in proportion to the bytes (fractions of tokens).

Sections cover the document: a section ends where the next one starts, and the separator belongs to the section before
it. So the counts of a document's sections add up to its tokens under every rule.

Nulls and empty texts have one section, of no tokens. Repeated rows each get their rows. Text that is long without a
break is encoded piece by piece by the tokenizer's own pattern, never cut; long white space is found here, as the pattern
would find it, because its matcher has no room for it. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into pieces that are encoded one by one (a fixed value that goes with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "most", "split")
#: Runs of white space (as the pattern's engine has it) that are cut out before the pattern sees them.
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
_LOADED: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """(encoding, byte length of each id); loaded once per process."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            size[i] = len(piece)
        _LOADED[vocabulary] = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _LOADED[vocabulary]


def allocate(ends: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """``ends``: byte ends of a document's tokens; ``starts``: byte starts of its sections (the first is 0) -> tokens per
    section."""
    n = len(starts)
    out = np.zeros(n)
    if not len(ends):
        return out
    begins = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    whole = first == last
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    out += np.bincount(first[whole], minlength=n)
    # Only the tokens that cross a boundary are looked at one by one.
    for k in np.flatnonzero(~whole):
        parts = np.arange(first[k], last[k] + 1)
        a = np.maximum(starts[parts], begins[k])
        z = np.minimum(np.append(starts[parts[1:]], ends[k]), ends[k])
        if rule == "most":
            out[parts[np.argmax(z - a)]] += 1
        else:
            out[parts] += (z - a) / (ends[k] - begins[k])
    return out


def encoded(encoding, text: str) -> list[int]:
    """The ids of ``encoding.encode_ordinary(text)``, also where that fails for very long white space.

    No piece of the pattern reaches into a run of white space from before it, apart from single blanks in front of a word.
    In a run the pattern takes all but its last character, or all at the end of the text, as one piece, and goes on from
    there. So the text before a run, that piece, and what follows can be encoded one by one."""
    out: list[int] = []
    at = 0
    for m in LONG_BLANK.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at:m.start()])
        out += encoding._encode_single_piece(text[m.start():end])
        at = end
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def count(text: str, starts: list[int], rule: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Tokens per section of one text; ``starts`` in bytes of its UTF-8 form."""
    encoding, size = encoder(vocabulary)
    ids = np.array(encoded(encoding, text), np.int64)
    return allocate(np.cumsum(size[ids]), np.array(starts, np.int64), rule)


def line_starts(text: str) -> list[int]:
    """Byte starts of the lines of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    cuts = np.flatnonzero(raw == 10) + 1
    return [0, *cuts[cuts < len(raw)].tolist()]


def attributed_lines(docs: DataFrame, key: str = "doc_id", rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """key, section (line number from 0), start_byte, n_tokens, doc_tokens; one row per line of ``text``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        for b in batches:
            rows, section, at, tokens, whole = [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                starts = line_starts(t or "")
                n = count(t or "", starts, rule, vocabulary)
                rows += [i] * len(n)
                section += range(len(n))
                at += starts
                tokens += n.tolist()
                whole += [round(n.sum())] * len(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(section, pa.int64()), pa.array(at, pa.int64()),
                                              pa.array(tokens, pa.float64()), pa.array(whole, pa.int64())], [key, "section", "start_byte", "n_tokens", "doc_tokens"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, section long, start_byte long, n_tokens double, doc_tokens long")


def attributed_fields(rows: DataFrame, key: str, fields: list[str], separator: str = "\n", rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """key, field, n_tokens, doc_tokens: the fields of a row are joined by ``separator`` (which counts to the field before
    it), encoded once, and the tokens attributed to the fields. A null field is empty."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        for b in batches:
            own, names, tokens, whole = [], [], [], []
            cols = [b.column(1 + i).to_pylist() for i in range(len(fields))]
            for i, values in enumerate(zip(*cols)):
                parts = [(v or "") + (separator if k + 1 < len(fields) else "") for k, v in enumerate(values)]
                sizes = [len(p.encode("utf-8", "surrogatepass")) for p in parts]
                # Fields of no bytes hold no token; they would share their start with the next one.
                held = [k for k, s in enumerate(sizes) if s]
                n = np.zeros(len(fields))
                if held:
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[held]
                    n[held] = count("".join(parts), starts.tolist(), rule, vocabulary)
                own += [i] * len(fields)
                names += fields
                tokens += n.tolist()
                whole += [round(n.sum())] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array(names, pa.string()), pa.array(tokens, pa.float64()), pa.array(whole, pa.int64())],
                                             [key, "field", "n_tokens", "doc_tokens"])

    kind = rows.select(key).schema[0].dataType.simpleString()
    return rows.select(key, *fields).mapInArrow(run, f"`{key}` {kind}, field string, n_tokens double, doc_tokens long")


def op2_tokens(docs: DataFrame) -> DataFrame:
    """Every line of every document, under the start rule, whose counts are whole numbers."""
    return attributed_lines(docs).withColumn("n_tokens", F.col("n_tokens").cast("long"))
