"""Byte-level BPE ids, and operator 9: edit-aware token counts.

Ids are those of the tokenizer file ``byte_bpe_50k.json``. They are made by the
rank form of the same vocabulary, which is several times faster; the tests hold
both against each other. The vocabulary's path is a parameter.

Edit-aware counting keeps, for each document, a segment tree over its pre-tokens:
BPE never crosses a pre-token, so the count of a text is the sum over its
pre-tokens. Leaves are runs of whole pre-tokens of about ``LEAF`` characters with
their length and token count; inner nodes are sums. An edit re-encodes only the
leaves that it touches, plus the leaf before it where the edit touches the cut
between them, extended to the right until an old cut is a cut of the new text too,
and updates the sums.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LEAF = 256
END_ID = 2

_DOUBLE_SPACE = regex.compile(r"\s\s")
#: A special token in the text is one leaf's business only if no cut can fall into it; it holds no space.
#: Between a character that is no white space and a space there is always a pre-token
#: boundary, whatever stands around, and a slice that ends there is encoded as in its text.
_CUT = regex.compile(r"(?<=\S)(?= )")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """text -> uint32 array of ids."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    # the JSON form of the vocabulary finds its special tokens in texts; so does this form
    special = {"<|endoftext|>": len(ranks)}
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    # without two white-space characters in a row the look-ahead alternative never matters, and a pattern
    # without it is matched by a faster engine
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            return np.array(whole.encode(text, allowed_special="all"), dtype=np.uint32)
        chosen = whole if _DOUBLE_SPACE.search(text) or text[-1:].isspace() else plain
        try:
            return np.frombuffer(chosen._core_bpe.encode_to_tiktoken_buffer(text, set()), dtype=np.uint32)
        except UnicodeEncodeError:
            return np.array(chosen.encode_ordinary(text), dtype=np.uint32)

    return encode


class SegmentTree:
    """Sums of (characters, tokens) over leaves that are runs of whole pre-tokens."""

    def __init__(self, encode, text: str, leaf: int = LEAF):
        self.encode, self.leaf, self.encoded_chars = encode, leaf, 0
        self.text = text
        self._set(self._leaves(text, 0, len(text)))

    def _leaves(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Leaves of text[start:end]; both ends are cuts of the text."""
        out, at = [], start
        while at < end:
            found = _CUT.search(text, at + self.leaf, end) if end - at > self.leaf else None
            cut = found.start() if found else end
            out.append((cut - at, len(self.encode(text[at:cut]))))
            self.encoded_chars += cut - at
            at = cut
        return out

    def _set(self, leaves: list[tuple[int, int]]) -> None:
        size = 1
        while size < max(1, len(leaves)):
            size *= 2
        self.n, self.size = len(leaves), size
        chars, tokens = np.zeros(2 * size, dtype=np.int64), np.zeros(2 * size, dtype=np.int64)
        if leaves:
            chars[size : size + self.n], tokens[size : size + self.n] = np.array(leaves, dtype=np.int64).T
        for tree in (chars, tokens):
            low = size
            while low > 1:
                tree[low // 2 : low] = tree[low : 2 * low : 2] + tree[low + 1 : 2 * low : 2]
                low //= 2
        self.chars, self.tokens = chars, tokens

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, offset: int) -> tuple[int, int]:
        """(leaf, its start) of the leaf that holds the character at ``offset``."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if offset >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def edit(self, offset: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters at ``offset`` by ``inserted``."""
        old, length = self.text, len(self.text)
        offset = max(0, min(offset, length))
        removed = max(0, min(removed, length - offset))
        self.text = old[:offset] + inserted + old[offset + removed :]
        if not self.n:
            self._set(self._leaves(self.text, 0, len(self.text)))
            return
        first, start = self.find(max(0, min(offset, length - 1)))
        if first > 0 and offset <= start:  # boundary context: the cut itself is touched
            first -= 1
            start -= int(self.chars[self.size + first])
        last, end_of = self.find(min(offset + removed, length - 1))
        end = end_of + int(self.chars[self.size + last])
        shift = len(inserted) - removed
        while last + 1 < self.n and not (end >= offset + removed and end + shift > start and _CUT.match(self.text, end + shift)):
            last += 1
            end += int(self.chars[self.size + last])
        fresh = self._leaves(self.text, start, min(end + shift, len(self.text)))
        if len(fresh) == last - first + 1:
            for k, (chars, tokens) in enumerate(fresh):
                self._update(first + k, chars, tokens)
        else:
            leaves = [*zip(self.chars[self.size : self.size + self.n].tolist(), self.tokens[self.size : self.size + self.n].tolist(), strict=True)]
            self._set(leaves[:first] + fresh + leaves[last + 1 :])

    def _update(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        for tree, value in ((self.chars, chars), (self.tokens, tokens)):
            at, delta = node, value - tree[node]
            while at:
                tree[at] += delta
                at //= 2


EDIT_SCHEMA = "array<struct<offset:long,removed:long,inserted:string>>"
STATE = "doc_id long, n_chars long, n_tokens long, n_chars_edited long, n_tokens_edited long, n_encoded long"


def count_tokens(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Token counts of each document before and after its edits.

    ``docs``: doc_id, text, and optionally ``edits``, an array of structs (offset,
    removed, inserted) that apply in order, each to the text that the one before
    left (offsets and lengths in code points, clipped to the text). Returns doc_id,
    n_chars, n_tokens, the same after the edits, and n_encoded: the characters that
    the edits made the tokenizer read again. Null text counts as empty; null edits,
    and null members of them, as none. One row out per row in, so repeated rows and
    empty tables need nothing special; other columns are not read.
    """
    path = path or vocabulary()
    has_edits = "edits" in docs.columns

    def count(batches):
        encode = encoder(path)
        for batch in batches:
            out = [[], [], [], [], []]
            edits = batch.column("edits").to_pylist() if has_edits else None
            for k, text in enumerate(batch.column("text").to_pylist()):
                text, todo = text or "", [e for e in (edits[k] or []) if e] if has_edits else []
                if todo:
                    tree = SegmentTree(encode, text, leaf)
                    total, read = tree.total, tree.encoded_chars
                    for e in todo:
                        tree.edit(e["offset"] or 0, e["removed"] or 0, e["inserted"] or "")
                    row = (len(text), total, len(tree.text), tree.total, tree.encoded_chars - read)
                else:
                    total = len(encode(text))
                    row = (len(text), total, len(text), total, 0)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in out]], names=[x.split()[0] for x in STATE.split(", ")])

    return docs.select("doc_id", "text", *["edits"] * has_edits).mapInArrow(count, STATE)
