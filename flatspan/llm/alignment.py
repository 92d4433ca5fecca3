"""Alignment of two tokenizers' tokens over all documents, with corpus-wide counts of linked pairs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatspan.llm.common import as_utf8, stored
from flatspan.llm.minimal_hash import MinimalHash

#: Where the vocabulary files are, and their names: byte-level BPE (A) and pieces with byte fallback (B).
FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text of a block (one document at least), and blocks whose counts are summed together before they meet the others.
BLOCK_BYTES, BRANCH = 2 << 20, 2048
#: Parts of the pairs by their A id. A part has at most (A's entries / PARTS) x B's entries pairs, 25 million of 4 bytes here.
PARTS = 64
#: Bits of a B id in a pair's key.
B_BITS = 20
#: Distinct pieces that a worker remembers, so that frequent ones go through the tokenizers once.
REMEMBERED = 120_000
#: Bytes of pieces that go through a tokenizer together.
_TOGETHER = 32_000

#: White space and what looks like it in any version of Unicode.
_WHITE = r"\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
#: A blank between two characters of which neither is white space; texts that have other blanks; pieces that begin or end with white space.
_CUT = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
_ODD = re.compile(rf"[{_WHITE}] | [{_WHITE}]|^ | \Z")
_EDGE = re.compile(rf"^[{_WHITE}]|[{_WHITE}]\Z")


class Vocabularies:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, a_file: bytes, b_file: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_proto=b_file)
        shown = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(shown[c] for c in entry) if all(c in shown for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        #: B never joins what stands before a blank with what follows if no entry has a blank after another character.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _lexicon(a_file: bytes, b_file: bytes) -> Lexicon:
    return Lexicon(Vocabularies(a_file, b_file))


def pieces_of(text: str, cuts: bool = True) -> list[str]:
    """The text cut before blanks that stand between other characters (the blanks go); no token of A or B holds both sides of one.

    A's pattern lets a blank begin a run of letters, numbers or signs but never follow one. With its own blank before it,
    each piece has the tokens that it has in the whole text.
    """
    if not cuts:
        return [text]
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def _distinct(ascending: np.ndarray) -> np.ndarray:
    return ascending[np.append(True, ascending[1:] != ascending[:-1])] if len(ascending) else ascending


@dataclass
class Tokens:
    """Token ids of distinct pieces, one piece after another, and how many each has; ok: both tokenizers give its bytes back."""

    ok: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    def extended(self, more: Tokens) -> Tokens:
        return Tokens(*[np.concatenate([getattr(self, f.name), getattr(more, f.name)]) for f in fields(self)])

    def of(self, pieces: np.ndarray) -> Tokens:
        n_a, n_b = self.n_a[pieces], self.n_b[pieces]
        return Tokens(self.ok[pieces], self.a[_spread((np.cumsum(self.n_a) - self.n_a)[pieces], n_a)], self.b[_spread((np.cumsum(self.n_b) - self.n_b)[pieces], n_b)], n_a, n_b)


@dataclass
class Aligned:
    """Groups and overlapping pairs of the tokens of pieces, piece by piece."""

    n_groups: np.ndarray
    a_last: np.ndarray  # whether an A (B) token ends a group
    b_last: np.ndarray
    keys: np.ndarray  # of the pairs
    n_links: np.ndarray


def tokenized(pieces: list[str], v: Vocabularies) -> Tokens:
    """Pieces go through the tokenizers in strings of many. Where a string's tokens don't give its bytes back, its pieces go
    alone, and those that still don't have no tokens.
    """
    found: list[tuple[list[int], list[int]]] = []  # of each string
    order: list[np.ndarray] = []  # its pieces
    sizes = np.array([len(p.encode()) + 1 for p in pieces], dtype=np.int64)
    alone = np.array([not p or _EDGE.search(p) is not None for p in pieces], dtype=bool)
    ok = np.ones(len(pieces), dtype=bool)
    together = np.flatnonzero(~alone)
    strings = np.split(together, np.flatnonzero(np.diff(np.cumsum(sizes[together]) // _TOGETHER)) + 1) if len(together) else []

    def add(group: np.ndarray) -> None:
        text = " ".join([pieces[k] for k in group])
        a, b = (x[0] for x in v.ids([text]))
        raw = b" " + text.encode()
        if b"".join([v.a_bytes[i] for i in a]) == raw and b"".join([v.b_bytes[i] for i in b]) == raw:
            ends = np.cumsum(sizes[group])
            if len(group) == 1 or (np.isin(ends, np.cumsum(v.a_size[a])).all() and np.isin(ends, np.cumsum(v.b_size[b])).all()):
                found.append((a, b))
                order.append(group)
                return
        if len(group) == 1:
            ok[group] = False
        else:
            for k in group:
                add(np.array([k]))

    for g in [*strings, *np.flatnonzero(alone)[:, None]]:
        add(g)
    rank = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
    ends, ids, counts = np.cumsum(sizes[rank]), [], []
    for k, size in enumerate((v.a_size, v.b_size)):
        flat = np.array([i for x in found for i in x[k]], dtype=np.int64)
        piece = rank[np.searchsorted(ends, np.cumsum(size[flat]))]
        ids.append(flat[np.argsort(piece, kind="stable")])
        counts.append(np.bincount(piece, minlength=len(pieces)))
    return Tokens(ok, *ids, *counts)


def aligned(t: Tokens, v: Vocabularies) -> Aligned:
    """Byte ranges of A and B tokens, met at their ends. All pieces lie one after another, and each begins and ends with both tokenizers' tokens."""
    a_ends, b_ends = np.cumsum(v.a_size[t.a]), np.cumsum(v.b_size[t.b])
    ends = np.cumsum(_segments(v.a_size[t.a], t.n_a))
    every = np.sort(np.concatenate([a_ends, b_ends]))
    twice = every[1:] == every[:-1] if len(every) else np.zeros(0, dtype=bool)
    both, cuts = every[1:][twice], _distinct(every)
    # between two cuts lies one A token and one B token: a pair that overlaps, each once
    keys = (t.a[np.searchsorted(a_ends, cuts)] << B_BITS) | t.b[np.searchsorted(b_ends, cuts)]
    upto = lambda x: np.diff(np.searchsorted(x, ends, side="right"), prepend=0)  # noqa: E731  how many of x each piece has
    return Aligned(upto(both), _within(a_ends, both), _within(b_ends, both), keys, upto(cuts))


def _within(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x if len(ascending) else np.zeros(len(x), dtype=bool)


def group_texts(t: Tokens, x: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for every piece."""
    joined = []
    for ids, last in ((t.a, x.a_last), (t.b, x.b_last)):
        said, out, at = list(map(str, ids.tolist())), [], 0
        for end in (np.flatnonzero(last) + 1).tolist():
            out.append(",".join(said[at:end]) if end - at > 1 else said[at])
            at = end
        joined.append(out)
    groups, out, at = [f"{a}|{b}" for a, b in zip(*joined, strict=True)], [], 0
    for n in x.n_groups.tolist():
        out.append(";".join(groups[at : at + n]) if n > 1 else "".join(groups[at : at + n]))
        at += n
    return out


@dataclass
class Block:
    """The texts of a block as numbers of its distinct pieces, and those pieces' tokens."""

    which: np.ndarray  # piece of every place
    size: np.ndarray  # places of each text
    tokens: Tokens

    def documents(self) -> np.ndarray:
        """The text of every place."""
        return np.repeat(np.arange(len(self.size)), self.size)

    def sums(self, by_piece: np.ndarray) -> np.ndarray:
        """By text."""
        return _segments(by_piece[self.which], self.size)

    def whole(self) -> np.ndarray:
        """Texts that have tokens: not empty, and both tokenizers give every byte back."""
        return (self.sums((~self.tokens.ok).astype(np.int64)) == 0) & (self.size > 0)

    def to_row(self) -> dict[str, bytes]:
        t = self.tokens
        return {"which": _narrow(self.which), "size": self.size.astype("<i8").tobytes(), "ok": t.ok.tobytes()} | {k: _narrow(getattr(t, k)) for k in ("a", "b", "n_a", "n_b")}

    @classmethod
    def from_row(cls, r: dict) -> Block:
        size, ok = np.frombuffer(r["size"], dtype="<i8"), np.frombuffer(r["ok"], dtype=bool)
        n_a, n_b = (_wide(r[k], len(ok)) for k in ("n_a", "n_b"))
        return cls(_wide(r["which"], size.sum()), size, Tokens(ok, _wide(r["a"], n_a.sum()), _wide(r["b"], n_b.sum()), n_a, n_b))


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in two bytes each where they fit, else four, compressed."""
    return zlib.compress(x.astype("<u2" if len(x) and x.max() < 1 << 16 else "<u4").tobytes(), 1)


def _wide(raw: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}" if n else "<u4").astype(np.int64)


class Lexicon:
    """Pieces met by a worker and their tokens; begins anew beyond REMEMBERED pieces."""

    def __init__(self, v: Vocabularies):
        self.v, self.number = v, defaultdict()
        self.forget()

    def forget(self) -> None:
        self.number.default_factory = None  # it refers to its dictionary, which would stay until garbage is looked for
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.tokens = tokenized([], self.v)

    def block(self, raws: list[bytes]) -> Block:
        if len(self.number) > REMEMBERED:
            self.forget()
        number, which, size, known = self.number, [], [], len(self.number)
        for raw in raws:
            own = pieces_of(raw.decode(), self.v.cuts) if raw else []
            which += map(number.__getitem__, own)
            size.append(len(own))
        if len(number) > known:
            self.tokens = self.tokens.extended(tokenized(list(islice(number, known, None)), self.v))
        used, own = np.unique(np.array(which, dtype=np.int64), return_inverse=True)
        return Block(own, np.array(size, dtype=np.int64), self.tokens.of(used))


def _segments(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of segments of so many values, in whole numbers."""
    total, end = np.append(0, np.cumsum(values)), np.cumsum(sizes)
    return total[end] - total[end - sizes]


def pair_counts(block: Block, x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ascending; number of the block's documents that hold each linked)."""
    doc = block.documents()
    keep = block.whole()[doc]
    seen = _distinct(np.sort((doc[keep] << 32) | block.which[keep]))
    doc, piece = seen >> 32, seen & 0xFFFFFFFF
    kinds, number = np.unique(x.keys, return_inverse=True)
    n = x.n_links[piece]
    held = (np.repeat(doc, n) << 32) | number[_spread((np.cumsum(x.n_links) - x.n_links)[piece], n)]
    count = np.bincount(_distinct(np.sort(held)) & 0xFFFFFFFF, minlength=len(kinds))
    return kinds[count > 0], count[count > 0]


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of n."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return zlib.compress(np.diff(keys, prepend=0).astype("<i8").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), dtype="<i8"))


def _numbers(n: np.ndarray) -> bytes:
    return zlib.compress(n.astype("<i8").tobytes(), 1)


def _read(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype="<i8")


def _one(b: pd.DataFrame) -> dict:
    return b.iloc[0].to_dict()


CELLS = "cells array<struct<part int, keys binary, n binary>>"
ROW = f"ids binary, no_id binary, which binary, size binary, ok binary, a binary, b binary, n_a binary, n_b binary, {CELLS}"


def _cells(block: Block, x: Aligned) -> list[dict]:
    keys, n = pair_counts(block, x)
    part = (keys >> B_BITS) % PARTS
    return [{"part": p, "keys": _packed(keys[part == p]), "n": _numbers(n[part == p])} for p in np.unique(part).tolist()]


def tokenized_blocks(docs: DataFrame, files: Broadcast) -> DataFrame:
    """A row a block of documents that stand together: their ids and tokens, and the block's distinct linked pairs, stored in the shared folder.

    Nothing is shuffled. Numbers of blocks are fixed once written, so a lost executor changes none.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(*files.value)

        def row(held: list) -> pd.DataFrame:
            block = lexicon.block([r.raw for r in held])
            ids = {"ids": np.array([r.id for r in held], dtype="<i8").tobytes(), "no_id": np.array([r.no_id for r in held], dtype=bool).tobytes()}
            return pd.DataFrame([ids | block.to_row() | {"cells": _cells(block, aligned(block.tokens, lexicon.v))}])

        held, size = [], 0
        for b in batches:
            for r in b.itertuples(index=False):
                held.append(r)
                size += len(r.raw)
                if size >= BLOCK_BYTES or len(held) >= 100_000:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), as_utf8(F.coalesce("text", F.lit(""))).alias("raw"))
    return stored(rows.mapInPandas(read, ROW).withColumn("block", F.monotonically_increasing_id()))


def align_documents(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every whole text.

    First pass: texts are tokenized once and stored as ids, in blocks; each block sends its distinct linked pairs, cut in parts by
    A id, with the number of its documents that hold each. A part unites its pairs and gives them a minimal perfect hash function; blocks' numbers become dense
    vectors indexed by it, summed in a tree (blocks of a branch, then branches), and keys kept in the same order verify every
    lookup. An A id's pairs are all in one part, so its highest count is known there. Second pass: documents are aligned
    again, from the stored ids, and look up the counts of their block's pairs.

    A null or empty text, or one whose tokens don't give back its bytes, has zeros and an empty digest. Repeated
    rows each get a row and each count as a document; a null id stays null; an empty table gives an empty result; further
    columns are ignored. The vocabularies are read in ``folder`` on the driver and sent to the tasks: their size is that of two
    files, whatever the documents.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(tuple((Path(folder) / f).read_bytes() for f in (A_FILE, B_FILE)))
    blocks = tokenized_blocks(docs, files)
    branches = max(1, math.ceil(blocks.count() / BRANCH))
    of_branch = F.pmod(F.xxhash64("block"), F.lit(branches)).cast("int").alias("branch")
    cells = blocks.select("block", of_branch, F.explode("cells").alias("c")).select("c.part", "branch", "block", "c.keys", "c.n")

    def unite(g: pd.DataFrame) -> pd.DataFrame:
        kinds = np.unique(np.concatenate([_unpacked(k) for k in g["keys"]]))
        return pd.DataFrame({"part": g["part"].iloc[:1], "keys": [_packed(kinds)]})

    def hashed(g: pd.DataFrame) -> pd.DataFrame:
        """The part's function, and its keys in the function's order."""
        kinds = np.unique(np.concatenate([_unpacked(k) for k in g["keys"]]))
        f = MinimalHash.build(kinds)
        order = np.empty(len(kinds), dtype=np.int64)
        order[f(kinds)] = kinds
        return pd.DataFrame({"part": g["part"].iloc[:1], "hash": [f.to_bytes()], "keys": [_numbers(order)]})

    united = cells.groupBy("part", "branch").applyInPandas(unite, "part int, keys binary")
    functions = stored(united.groupBy("part").applyInPandas(hashed, "part int, hash binary, keys binary"))
    to_all = F.explode(F.sequence(F.lit(0), F.lit(branches - 1))).alias("branch")

    def add(g: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame({"part": [], "n": []})
        own = MinimalHash.from_bytes(_one(f)["hash"])
        dense = np.zeros(len(own), dtype=np.int64)
        for keys, n in zip(g["keys"], g["n"], strict=True):
            dense[own(_unpacked(keys))] += _read(n)  # keys of a cell are distinct
        return pd.DataFrame({"part": g["part"].iloc[:1], "n": [_numbers(dense)]})

    def total(g: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        """Counts in the function's order, and whether each is the highest of its A id."""
        keys, n = _read(_one(f)["keys"]), sum(_read(x) for x in g["n"])
        _, a = np.unique(keys >> B_BITS, return_inverse=True)
        top = np.zeros(a.max() + 1, dtype=np.int64)
        np.maximum.at(top, a, n)
        return f.assign(n=[_numbers(n)], best=[np.packbits(n == top[a]).tobytes()])

    vectors = cells.groupBy("part", "branch").cogroup(functions.select("part", to_all, "hash").groupBy("part", "branch")).applyInPandas(add, "part int, n binary")
    counts = stored(vectors.groupBy("part").cogroup(functions.groupBy("part")).applyInPandas(total, "part int, hash binary, keys binary, n binary, best binary"))

    def answer(g: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(g):
            f = _one(f)
            own, held, n = MinimalHash.from_bytes(f["hash"]), _read(f["keys"]), _read(f["n"])
            best = np.unpackbits(np.frombuffer(f["best"], dtype=np.uint8), count=len(own)).astype(bool)
            for block, keys in zip(g["block"], g["keys"], strict=True):
                asked = _unpacked(keys)
                at = own(asked)
                if (at < 0).any() or (held[at] != asked).any():
                    raise RuntimeError("a pair of a block has no count")
                out.append((block, keys, _numbers(n[at]), np.packbits(best[at]).tobytes()))
        return pd.DataFrame(out, columns=["block", "keys", "n", "best"])

    answers = cells.groupBy("part", "branch").cogroup(counts.select("*", to_all).groupBy("part", "branch")).applyInPandas(answer, "block long, keys binary, n binary, best binary")

    def look_up(b: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        b = _one(b)
        own = Block.from_row(b)
        x, good = aligned(own.tokens, _lexicon(*files.value).v), own.whole()
        keys = np.concatenate([np.zeros(0, dtype=np.int64), *[_unpacked(k) for k in said["keys"]]])
        n = np.concatenate([np.zeros(0, dtype=np.int64), *[_read(k) for k in said["n"]]])
        best = np.concatenate([np.zeros(0, dtype=bool), *[np.unpackbits(np.frombuffer(k, dtype=np.uint8), count=len(_unpacked(q))).astype(bool) for k, q in zip(said["best"], said["keys"], strict=True)]])
        order = np.argsort(keys)
        keys, n, best = keys[order], n[order], best[order]
        # pairs that only texts without tokens hold have no count; no sum uses them
        at = np.minimum(np.searchsorted(keys, x.keys), max(len(keys) - 1, 0))
        known = keys[at] == x.keys if len(keys) else np.zeros(len(x.keys), dtype=bool)
        by_piece = lambda w: _segments(np.where(known, w[at] if len(w) else 0, 0), x.n_links)
        texts, which, first = group_texts(own.tokens, x), own.which.tolist(), (np.cumsum(own.size) - own.size).tolist()
        digests = [hashlib.sha256(";".join([texts[k] for k in which[s : s + m]]).encode()).hexdigest() if ok else "" for s, m, ok in zip(first, own.size.tolist(), good.tolist(), strict=True)]
        count = lambda by: np.where(good, own.sums(by), 0)
        return pd.DataFrame({
            "id": np.frombuffer(b["ids"], dtype="<i8"), "no_id": np.frombuffer(b["no_id"], dtype=bool), "n_a": count(own.tokens.n_a), "n_b": count(own.tokens.n_b), "n_groups": count(x.n_groups),
            "n_links": count(x.n_links), "n_best": count(by_piece(best)), "count_sum": count(by_piece(n)), "groups_sha256": digests,
        })

    done = blocks.drop("cells").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(look_up, "id long, no_id boolean, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return done.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), *done.columns[2:])
