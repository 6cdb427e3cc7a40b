"""BPE encoding and decoding by tree concatenation.

Every text is cut in halves, and these again, down to leaves of at most ``LEAF`` characters, wherever
the middle falls. The leaves of many texts are encoded together; then neighbours are joined pairwise
up the tree, all joins of one level together. A join encodes a window around its seam again: the
word that the seam cuts and ``reach`` words on either side. It stands when the window's ids begin
with those the left side has for its words there and end with those the right side has; else the
reach doubles until they agree or the window is all of a side. Blanks separate words before merging,
so words whose ids agree on both sides of the cut one make the rest of either side independent of
the seam.

A word longer than ``LEAF`` offers no such place. Its leaves carry tokens, and the windows are
counted in characters: a join stands when the window and the side share one whole token on either
side of the seam. Each pair of adjacent tokens of the result then stands side by side in one of the
three encodings, and a sequence whose adjacent pairs all encode to themselves is the encoding of its
text, as the first merge across a boundary would show in that pair already. That argument needs one
class of characters throughout, so a word of mixed classes also needs the shared token to end a
pre-token.

A leaf's words are remembered with their ids, as the library does in its own cache, so equal words
are merged once a worker; at most ``REMEMBERED`` characters of words are held, and those of the texts
in hand. A plain word (``PLAIN``) is two pre-tokens at most, its letters and the signs behind them.
Pre-tokens are merged apart, so each is remembered too, and the library's model merges the letters
without a pass through its normalizer; all other words go through the whole library.

Defined cases: a null text is the empty text (no ids); rows with a null doc_id stay; repeated rows
give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spliceflow.llm.common import id_text, in_batches

LEAF, REACH = 1024, 1
#: Characters of remembered words a worker; those not met again lately are forgotten beyond it. Words beyond ``LONG`` characters are not remembered.
REMEMBERED, LONG = 4_000_000, 64
WORD_END = "</w>"
#: Letters that stand composed whatever follows within the word, then ASCII signs but the apostrophe, which begins pre-tokens of its own.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
Token = tuple[int, int, int]
_state: dict[str, "Encoder"] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Part:
    """The encoding of text[start:end]: ids of each blank-separated word, as joined strings.

    ``head`` and ``tail`` hold the bounds and tokens of a first or last word that spans several leaves.
    """

    __slots__ = ("start", "end", "ids", "head", "tail")

    def __init__(self, start: int, end: int, ids: list[str], head: tuple | None = None, tail: tuple | None = None):
        self.start, self.end, self.ids, self.head, self.tail = start, end, ids, head, tail


def _back(text: str, start: int, end: int, words: int) -> int:
    """Where the last ``words`` words of text[start:end] begin."""
    at = end
    for _ in range(words):
        while at > start and text[at - 1] == " ":
            at -= 1
        at = text.rfind(" ", start, at) + 1 or start
    return at


def _ahead(text: str, start: int, end: int, words: int) -> int:
    """Where the first ``words`` words of text[start:end] end."""
    at = start
    for _ in range(words):
        while at < end and text[at] == " ":
            at += 1
        at = text.find(" ", at, end)
        if at < 0:
            return end
    return at


class _Words(dict):
    """Ids of words, joined by blanks; ``old`` holds those of the generation before."""

    def __init__(self, tokenizer, old: dict[str, str]):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.tokenizer, self.merge, self.old, self.held = tokenizer, tokenizer.model.tokenize, old, 0
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: The characters that stand for the bytes of the letters beyond ASCII.
        self.bytes = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(0xDF, 0x100)}

    def __missing__(self, word: str) -> str:
        got = self.old.get(word)
        if got is None:
            got = self.made(word)
        if len(word) <= LONG:
            self[word] = got
            self.held += len(word)
        return got

    def made(self, word: str) -> str:
        plain = PLAIN.fullmatch(word)
        if not plain:
            return " ".join(map(str, self.tokenizer.encode(word, add_special_tokens=False).ids))
        head, tail = plain[1].lower(), plain[2]
        if tail:
            return f"{self[head]} {self[tail]}"
        if head != word:
            return self[head]
        return " ".join([str(t.id) for t in self.merge(word if word.isascii() else word.translate(self.bytes))])


class Encoder:
    def __init__(self, path: str, leaf: int = LEAF, reach: int = REACH):
        self.tokenizer, self.leaf, self.reach = load(path), leaf, reach
        self.words = _Words(self.tokenizer, {})
        self.names = {str(i): t for t, i in self.tokenizer.get_vocab().items()}
        #: Ids of tokens that end a pre-token.
        self.ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def leaves(self, start: int, end: int) -> list[tuple[int, int]]:
        """Halves of halves, down to the leaf size."""
        if end - start <= self.leaf:
            return [(start, end)]
        middle = (start + end) // 2
        return self.leaves(start, middle) + self.leaves(middle, end)

    def many(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """For each text the number of ids, the ids joined by blanks, the decoded text and the number of joins."""
        texts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        cut = [self.leaves(0, len(t)) for t in texts]
        if self.words.held > REMEMBERED // 2:
            self.words.old = {}
            self.words = _Words(self.tokenizer, self.words)
        known = self.words.__getitem__
        level = [[Part(a, b, list(map(known, filter(None, t[a:b].split(" "))))) for a, b in c] for t, c in zip(texts, cut)]
        seams = [len(row) - 1 for row in level]
        while any(len(row) > 1 for row in level):
            pairs = [(i, k) for i, row in enumerate(level) for k in range(0, len(row) - 1, 2)]
            joined = self.join([(texts[i], level[i][k], level[i][k + 1]) for i, k in pairs])
            after: list[list[Part]] = [[] for _ in level]
            for (i, _), part in zip(pairs, joined):
                after[i].append(part)
            for i, row in enumerate(level):
                if len(row) % 2:
                    after[i].append(row[-1])
            level = after
        out = []
        for row, n in zip(level, seams):
            got = " ".join(filter(None, row[0].ids))
            each = got.split()
            out.append((len(each), got, " ".join(map(self.names.__getitem__, each)), n))
        return out

    def join(self, pairs: list[tuple[str, Part, Part]]) -> list[Part]:
        """The joins of one level. Words left and right of a window agree, or the window grows."""
        out: list[Part | None] = [None] * len(pairs)
        todo, places = [], []
        for k, (text, a, b) in enumerate(pairs):
            cut = text[a.end - 1] != " " and text[b.start] != " "
            if cut and _ahead(text, b.start, b.end, 1) - _back(text, a.start, a.end, 1) > 4 * self.leaf:
                out[k] = self._join_long(text, a, b)
            else:
                todo.append((k, cut, self.reach))
        while todo:
            places = [(_back(pairs[k][0], pairs[k][1].start, pairs[k][1].end, reach + cut), _ahead(pairs[k][0], pairs[k][2].start, pairs[k][2].end, reach + cut)) for k, cut, reach in todo]
            made = self._encode([pairs[k][0][h:p] for (k, _, _), (h, p) in zip(todo, places)])
            again = []
            for (k, cut, reach), (h, p), got in zip(todo, places, made):
                _, a, b = pairs[k]
                stop = len(a.ids) - cut
                # The words beside the seam's own, which a side and the window both hold.
                left = " ".join(filter(None, a.ids[max(0, stop - reach) : stop])).split()
                right = " ".join(filter(None, b.ids[cut : cut + reach])).split()
                ids, end = list(map(str, got.ids)), len(got.ids) - len(right)
                if len(left) <= end and ids[: len(left)] == left and ids[end:] == right and (cut or len(left) == end):
                    mid = [" ".join(ids[len(left) : end])] if cut else []
                    out[k] = Part(a.start, b.end, a.ids[:stop] + mid + b.ids[cut:], a.head, b.tail)
                elif h > a.start or p < b.end:
                    again.append((k, cut, 2 * reach))
                else:  # the window is both sides
                    out[k] = Part(a.start, b.end, [" ".join(ids)])
            todo = again
        return out

    def _tokens(self, text: str, start: int, end: int) -> list[Token]:
        made = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return [(i, a + start, b + start) for i, (a, b) in zip(made.ids, made.offsets)]

    def _join_long(self, text: str, a: Part, b: Part) -> Part:
        """The seam cuts a word of more than a few leaves: join its tokens."""
        seam, h, p = a.end, _back(text, a.start, a.end, 1), _ahead(text, b.start, b.end, 1)
        left = a.tail[2] if a.tail and a.tail[:2] == (h, seam) else self._tokens(text, h, seam)
        right = b.head[2] if b.head and b.head[:2] == (seam, p) else self._tokens(text, seam, p)
        tokens = self.join_tokens(text, left, right, h, seam, p)
        ids = [" ".join(str(t[0]) for t in tokens)]
        word = (h, p, tokens)
        return Part(a.start, b.end, a.ids[:-1] + ids + b.ids[1:], word if h == a.start else a.head, word if p == b.end else b.tail)

    def join_tokens(self, text: str, left: list[Token], right: list[Token], start: int, seam: int, end: int) -> list[Token]:
        """Tokens of text[start:end], which has no blank, from those of its two sides."""
        reach = 32
        while True:
            i = next((x for x in range(len(left) - 1, -1, -1) if left[x][1] <= seam - reach), 0)
            j = next((x for x in range(len(right)) if right[x][2] >= seam + reach), len(right) - 1)
            a = left[i][1] if i else start
            b = right[j][2] if j < len(right) - 1 else end
            made = self._tokens(text, a, b)
            if a == start and b == end:
                return made
            alike = text[a:b].isascii() and text[a:b].isalpha()
            fit = [alike or t[0] in self.ends for t in made]
            mine, yours = set(left[i:]), set(right[: j + 1])
            first = 0 if a == start else next((x for x, t in enumerate(made) if fit[x] and t[2] < seam and t in mine), None)
            last = len(made) - 1 if b == end else next((x for x in range(len(made) - 2, -1, -1) if fit[x] and made[x][1] >= seam and made[x] in yours), None)
            if first is not None and last is not None and first <= last:
                head = [] if a == start else left[: left.index(made[first], i)]
                tail = [] if b == end else right[right.index(made[last]) + 1 :]
                return head + made[first : last + 1] + tail
            reach *= 2


def encoder(path: str, leaf: int = LEAF) -> Encoder:
    if path not in _state:
        _state[path] = Encoder(path, leaf)
    return _state[path]


def encode(docs: DataFrame, path: str, ids: bool = True, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_joins, and with ``ids`` also ids array<int>, decoded."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = enc.many([t or "" for t in part.column("text").to_pylist()])
                cols = [
                    part.column("doc_id"), pa.array([g[0] for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got]), pa.array([hashlib.sha256(g[2].encode()).hexdigest() for g in got]),
                    pa.array([g[3] for g in got], pa.int64()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joins"]
                if ids:
                    cols += [pa.array([[int(x) for x in g[1].split()] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long" + (", ids array<int>, decoded string" if ids else "")
    return in_batches(id_text(docs)).mapInArrow(work, schema)
