"""SentencePiece byte-pair encoding and decoding in vectorised merge rounds.

A text becomes its normalised form (spaces as the mark U+2581, one in front) and is cut
before every run of marks: no piece holds a mark behind another character, so no merge crosses
such a cut.  The words that a worker has not met yet are encoded together: their
symbols lie in one flat array, each round looks up the rank of every neighbouring pair,
takes the smallest rank of each word (a segmented minimum), merges its leftmost occurrences at
once in all words, and compacts the array, until no pair remains.

Order matters where the merged piece could at once take part in a merge of smaller rank;
for such pieces a round merges the leftmost occurrence only, so that results equal those
of a queue that pops the best pair, leftmost first.  Symbols that are no piece end as bytes.

Null and empty texts have no ids and decode to the empty text.  Long words without spaces cost
rounds, not recursion.  The table of words met is dropped when it reaches ``CACHE_WORDS``.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from solvens.llm.common import add_columns

MARK = "▁"
#: Characters of the words whose ids a worker remembers.
CACHE_CHARS = 4_000_000
#: Characters of one vectorised call.
ROUND_CHARS = 1 << 20
#: Symbols from which a run that no border cuts is merged by a queue: a round's cost is the run's length.
LONG_RUN = 2_048
#: Characters of a word from which borders are looked for, and bits of the map of neighbours.
CUT_FROM, BORDER_BITS = 64, 20
NONE = np.int32(2**31 - 1)
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _side(a, b):
    return (a * 40_503 + b) & ((1 << BORDER_BITS) - 1)


class Encoder:
    """Vocabulary of a model as arrays: ids of single characters, and the sorted table of pairs that merge."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece holds the mark inside; words can't be encoded one by one")
        scores = np.array([model.get_score(i) for i in range(n)])
        # Equal scores share a rank: the leftmost of them merges first.
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        left, right, made = [], [], []
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        self.n, self.pair = n, None
        key = np.array(left, np.int64) * n + np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.made = key[order], np.array(made, np.int32)[order]
        self.rank_of_pair = rank[self.made].astype(np.int32)
        # safe: no merge that uses the piece has a rank below the piece's own
        self.safe = np.ones(n, bool)
        for part in (left, right):
            part = np.array(part, np.int64)
            early = rank[np.array(made)] <= rank[part]
            self.safe[part[early]] = False
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        # Marks all characters that a piece holds side by side (and a few others, by their hash): no merge crosses the border of two that aren't marked.
        self.adjacent = np.zeros(1 << BORDER_BITS, bool)
        self.adjacent[[_side(ord(x), ord(y)) for p in ids for x, y in zip(p[:-1], p[1:], strict=True)]] = True
        self.byte_id = {}
        self.raw = []
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            else:
                self.raw.append(b"" if special[i] else p.replace(MARK, " ").encode())

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index into the table of pairs, -1 where the pair doesn't merge."""
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), at, -1)

    def queued(self, symbols: list[int]) -> list[int]:
        """The merges of one long run, least rank first, leftmost of equals, each in logarithmic time."""
        if self.pair is None:
            self.pair = dict(zip(self.key.tolist(), zip(self.rank_of_pair.tolist(), self.made.tolist(), strict=True), strict=True))
        n, pair = len(symbols), self.pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = []

        def offer(i: int, j: int):
            a, b = symbols[i], symbols[j]
            found = pair.get(a * self.n + b) if a >= 0 and b >= 0 else None
            if found:
                waiting.append((found[0], i, a, b, found[1]))
                return True
            return False

        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(waiting)
        push = lambda i, j: offer(i, j) and heapq.heappush(waiting, waiting.pop())
        gone = -(2**40)
        while waiting:
            _, i, a, b, made = heapq.heappop(waiting)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, gone
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [s for s in symbols if s != gone]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; symbols that are no piece as bytes.  Words are cut into runs at the borders that no merge crosses."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.single[chars]
        symbols = np.where(symbols < 0, -1 - chars, symbols).astype(np.int64)
        ends = np.cumsum(lengths)
        border = ~self.adjacent[_side(chars[:-1], chars[1:])] if len(lengths) and lengths.max() >= CUT_FROM else np.zeros(max(0, len(chars) - 1), bool)
        border[ends[:-1] - 1] = True
        edges = np.r_[0, np.flatnonzero(border) + 1, len(chars)]
        of_word = np.searchsorted(ends, edges[:-1], side="right")
        sizes = np.diff(edges)
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_symbols, done_words = [], []
        if len(sizes) and sizes.max() >= LONG_RUN:
            for run in np.flatnonzero(sizes >= LONG_RUN).tolist():
                done_symbols.append(np.array(self.queued(symbols[edges[run] : edges[run + 1]].tolist()), np.int64))
                done_words.append(np.full(len(done_symbols[-1]), run))
            short = np.repeat(sizes < LONG_RUN, sizes)
            symbols, word = symbols[short], word[short]
        while len(symbols):
            at = self.lookup(np.maximum(symbols[:-1], -1), np.maximum(symbols[1:], -1))
            at[word[:-1] != word[1:]] = -1
            rank = np.where(at >= 0, self.rank_of_pair[at], NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(np.r_[rank, NONE], starts)
            busy = least != NONE
            counts = np.diff(np.r_[starts, len(symbols)])
            if not busy.all():
                rest = np.repeat(~busy, counts)
                done_symbols.append(symbols[rest]), done_words.append(word[rest])
                if not busy.any():
                    break
            best = np.repeat(np.where(busy, least, -1), counts)[:-1]
            hit = np.flatnonzero(rank == best)
            # Of overlapping occurrences in a row, every other one merges.
            chain = np.r_[True, np.diff(hit) > 1]
            head = np.maximum.accumulate(np.where(chain, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
            made = self.made[at[hit]]
            first = np.r_[True, word[hit][1:] != word[hit][:-1]]
            # An unsafe piece among a word's occurrences: only the leftmost merges.
            seen = np.flatnonzero(first)
            calm = np.logical_and.reduceat(self.safe[made], seen)
            take = first | np.repeat(calm, np.diff(np.r_[seen, len(hit)]))
            hit, made = hit[take], made[take]
            symbols[hit] = made
            keep = np.repeat(busy, counts)
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = np.concatenate(done_symbols or [symbols]), np.concatenate(done_words or [word])
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
        cut = np.searchsorted(of_word[word], np.arange(len(words) + 1))
        unknown = symbols < 0
        out = []
        for k in range(len(words)):
            own = symbols[cut[k] : cut[k + 1]]
            if unknown[cut[k] : cut[k + 1]].any():
                own = np.array([i for s in own.tolist() for i in ([s] if s >= 0 else [self.byte_id[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")])])
            out.append(own)
        return out

    def new_words(self, words: list[str], known: dict) -> None:
        """Puts the ids of ``words`` into ``known``, some ``ROUND_CHARS`` characters at a time."""
        at = 0
        while at < len(words):
            to, chars = at, 0
            while to < len(words) and (to == at or chars + len(words[to]) <= ROUND_CHARS):
                chars += len(words[to])
                to += 1
            for w, ids in zip(words[at:to], self.encode_words(words[at:to]), strict=True):
                known[w] = ids.tolist()
            at = to

    @staticmethod
    def words(text: str) -> list[str]:
        return WORDS.findall(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: pieces joined, bytes as UTF-8, the space in front dropped."""
        raw = self.raw
        out = b"".join([raw[i] for i in ids])
        return (out[1:] if ids and self.pieces[ids[0]].startswith(MARK) else out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_known: dict[str, dict] = {}
_held_chars: dict[str, int] = {}


def encode_each(path: str, texts):
    """Ids of each text in turn; the new words of about ``ROUND_CHARS`` characters of texts are encoded together."""
    own, known = encoder(path), _known.setdefault(path, {})
    held: list[list[str]] = []
    chars = 0

    def flush():
        if _held_chars.get(path, 0) > CACHE_CHARS:
            known.clear()
            _held_chars[path] = 0
        fresh = list({w for ws in held for w in ws if w not in known})
        _held_chars[path] = _held_chars.get(path, 0) + sum(map(len, fresh))
        own.new_words(fresh, known)
        for ws in held:
            yield [i for w in ws for i in known[w]]
        held.clear()

    for text in texts:
        held.append(own.words(text or ""))
        chars += len(text or "")
        if chars >= ROUND_CHARS:
            yield from flush()
            chars = 0
    yield from flush()


def token_digests(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256.

    Ids are hashed as decimals joined by commas, the text decoded from them as UTF-8.
    """

    def run(texts):
        own = encoder(model_path)
        n, ids_hash, text_hash = [], [], []
        for ids in encode_each(model_path, (t.as_py() for t in texts)):
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return add_columns(df, [text_col], fields, run)
