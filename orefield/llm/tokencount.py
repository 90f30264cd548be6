"""Edit-aware token counts: a segment tree over each document's pre-tokens, updated where an edit reaches.

A leaf covers a stretch of pre-tokens and holds their characters and tokens; inner nodes hold sums. Byte-pair merges stay
within a pre-token, and what a pre-token is depends only on the text from its start on (and one character beyond its
end), so an edit changes nothing before the leaf two characters left of it, and nothing after the first pre-token
boundary behind it that is an old leaf boundary as well.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.arrow import CACHE_BYTES, ENTRY_BYTES, held, map_texts

LEAF = 32


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter_(dict):
    """pre-token -> number of tokens, forgotten as a whole when it has grown to CACHE_BYTES."""

    def __init__(self, piece):
        super().__init__()
        self.piece, self.used = piece, 0

    def __missing__(self, token: str) -> int:
        n = len(self.piece(token))
        cost = 4 * len(token) + ENTRY_BYTES
        if self.used + cost > CACHE_BYTES:
            self.clear()
            self.used = 0
        if cost <= CACHE_BYTES:
            self[token] = n
            self.used += cost
        return n


class Tokenizer:
    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counted", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.counts = Counter_(self.encoding._encode_single_piece)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def number(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.counts.__getitem__, pieces), np.int64, len(pieces))


def load_tokenizer(path: str) -> Tokenizer:
    return held(("tokenizer", path), lambda: Tokenizer(path))


class Tree:
    """Two heap-ordered arrays of sums, characters and tokens; node 1 is the root, leaf i is node size + i."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens, self.size = chars, tokens, len(chars) // 2

    @classmethod
    def over(cls, chars: np.ndarray, tokens: np.ndarray) -> Tree:
        size = 1 << max(0, (len(chars) - 1).bit_length()) if len(chars) else 1
        out = []
        for leaves in (chars, tokens):
            nodes = np.zeros(2 * size, np.int64)
            nodes[size : size + len(leaves)] = leaves
            at = size
            while at > 1:
                nodes[at // 2 : at] = nodes[at : 2 * at].reshape(-1, 2).sum(axis=1)
                at //= 2
            out.append(nodes)
        return cls(*out)

    @classmethod
    def build(cls, text: str, tok: Tokenizer) -> Tree:
        return cls.over(*cls.leaves(tok.pieces(text), tok))

    @staticmethod
    def leaves(pieces: list[str], tok: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.arange(0, len(pieces), LEAF)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.add.reduceat(lengths, starts), np.add.reduceat(tok.number(pieces), starts)

    def find(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds this character, by descent; past the end: the last."""
        node, before = 1, 0
        char = min(char, max(0, int(self.chars[1]) - 1))
        while node < self.size:
            node *= 2
            left = int(self.chars[node])
            if char - before >= left:
                before += left
                node += 1
        return node - self.size, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """Set a leaf and the sums on its way to the root."""
        for nodes, value in ((self.chars, chars), (self.tokens, tokens)):
            node = leaf + self.size
            change = value - nodes[node]
            while node:
                nodes[node] += change
                node //= 2


def edit(text: str, tree: Tree, start: int, end: int, new: str, tok: Tokenizer) -> tuple[str, Tree, int]:
    """(text, tree, pre-tokens counted again) after text[start:end] becomes ``new``; the tree is changed in place."""
    n = len(text)
    start = max(0, min(start, n))
    end = max(start, min(end, n))
    text = text[:start] + new + text[end:]
    if n == 0 or not text:
        tree = Tree.build(text, tok)
        return text, tree, len(tok.pieces(text)) if text else 0
    first, begin = tree.find(max(0, start - 2))
    shift = len(new) - (end - start)
    # Old leaf boundaries behind the edit, where the old pre-tokens may set in again.
    leaf, low = tree.find(end)
    resume = low if low >= end and leaf > first else low + int(tree.chars[tree.size + leaf])
    leaf = leaf if low >= end and leaf > first else leaf + 1
    pieces, at = [], begin
    while at < len(text):
        while resume + shift < at and leaf < tree.size and tree.chars[tree.size + leaf]:
            resume += int(tree.chars[tree.size + leaf])
            leaf += 1
        if at == resume + shift and resume >= end:
            break
        piece = tok.pattern.match(text, at)[0]
        pieces.append(piece)
        at += len(piece)
    else:
        leaf = tree.size
    span = leaf - first
    used = int(np.flatnonzero(tree.chars[tree.size :])[-1]) + 1 if leaf == tree.size else leaf
    if leaf == tree.size:
        span = max(1, used - first)
    if len(pieces) <= 2 * LEAF * span and len(pieces) >= span:
        # The same leaves take the new pre-tokens, spread evenly; only their ways to the root change.
        counts = tok.number(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bounds = np.linspace(0, len(pieces), span + 1).astype(np.int64)
        for i in range(span):
            a, b = bounds[i], bounds[i + 1]
            tree.put(first + i, int(lengths[a:b].sum()), int(counts[a:b].sum()))
        return text, tree, len(pieces)
    chars, tokens = Tree.leaves(pieces, tok)
    old_chars, old_tokens = tree.chars[tree.size :], tree.tokens[tree.size :]
    chars = np.concatenate([old_chars[:first], chars, old_chars[first + span :]])
    tokens = np.concatenate([old_tokens[:first], tokens, old_tokens[first + span :]])
    some = chars > 0
    return text, Tree.over(chars[some], tokens[some]), len(pieces)


TREE = "tree_chars array<long>, tree_tokens array<long>"


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, also: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text, n_tokens, tree_chars, tree_tokens) for each row of docs, null texts as empty ones.

    ``also`` carries further columns along (name -> SQL expression). Write the result to keep the trees.
    """
    path = ranks or default_ranks()

    def make():
        tok = load_tokenizer(path)

        def work(texts, _):
            trees = [Tree.build(t.decode("utf-8", "replace"), tok) for t in texts]
            return {
                "n_tokens": np.array([int(t.tokens[1]) for t in trees], np.int64),
                "tree_chars": pa.array([t.chars for t in trees], pa.list_(pa.int64())),
                "tree_tokens": pa.array([t.tokens for t in trees], pa.list_(pa.int64())),
            }

        return work

    keep = {"doc_id": f"`{id_col}`", "text": f"coalesce(cast(`{text_col}` as string), '')"} | (also or {})
    return map_texts(docs, keep, f"n_tokens long, {TREE}", make, text_col)


def edits_of(table: DataFrame) -> DataFrame:
    """(doc_id, edits) from rows (doc_id, seq, start, end, new): each document's edits in order of seq."""
    one = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("new").cast("string").alias("new"))
    return table.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("edits"))


def apply_edits(state: DataFrame, edits: Column | str = "edits", ranks: str | None = None, with_text: bool = True) -> DataFrame:
    """(doc_id, text, n_before, n_tokens, n_chars, n_counted, tree_chars, tree_tokens): a row for each row of ``state``.

    ``edits`` is an array of (start, end, new) in characters of the text as the earlier edits left it; ends past the text
    are cut to it, a null array means no edit, a null ``new`` deletes. n_counted says how many pre-tokens were counted
    again. ``with_text`` false leaves text and trees out.
    """
    path = ranks or default_ranks()
    column = F.col(edits) if isinstance(edits, str) else edits
    plain = F.transform(column, lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), F.coalesce(e["new"], F.lit("")).alias("new")))
    rows = state.select("doc_id", "text", "n_tokens", "tree_chars", "tree_tokens", plain.alias("edits"))

    def make():
        tok = load_tokenizer(path)

        def work(texts, part):
            at = {n: part.column(part.schema.get_field_index(f"_k_{n}")) for n in ("tree_chars", "tree_tokens", "edits")}
            out: dict[str, list] = {n: [] for n in ("new_text", "now", "n_chars", "n_counted", "chars", "tokens")}
            for i, data in enumerate(texts):
                text = data.decode("utf-8", "replace")
                tree = Tree(np.array(at["tree_chars"][i].values, np.int64), np.array(at["tree_tokens"][i].values, np.int64))
                counted = 0
                for e in at["edits"][i].as_py() or []:
                    text, tree, n = edit(text, tree, e["start"] or 0, e["end"] if e["end"] is not None else e["start"] or 0, e["new"], tok)
                    counted += n
                for name, value in zip(out, (text, int(tree.tokens[1]), int(tree.chars[1]), counted, tree.chars, tree.tokens)):
                    out[name].append(value)
            made = {"now": np.array(out["now"], np.int64), "n_chars": np.array(out["n_chars"], np.int64), "n_counted": np.array(out["n_counted"], np.int64)}
            if with_text:
                lists = pa.list_(pa.int64())
                made |= {"new_text": pa.array(out["new_text"], pa.string()), "chars": pa.array(out["chars"], lists), "tokens": pa.array(out["tokens"], lists)}
            return made

        return work

    keep = {"doc_id": "doc_id", "n_before": "n_tokens", "tree_chars": "tree_chars", "tree_tokens": "tree_tokens", "edits": "edits"}
    fields = "now long, n_chars long, n_counted long" + (", new_text string, chars array<long>, tokens array<long>" if with_text else "")
    done = map_texts(rows, keep, fields, make)
    columns = ["doc_id", "n_before", F.col("now").alias("n_tokens"), "n_chars", "n_counted"]
    if with_text:
        columns += [F.col("new_text").alias("text"), F.col("chars").alias("tree_chars"), F.col("tokens").alias("tree_tokens")]
    return done.select(*columns)
