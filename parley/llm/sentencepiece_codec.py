"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file gives pieces and scores. A text is escaped (space -> U+2581, one in front)
and cut where a word ends and a U+2581 run begins; no piece crosses such a cut, so equal
segments encode alike and are encoded once; a bounded cache keeps them. New segments lie
in one flat numpy symbol array. In each round a pair merges if no pair of its segment within
reach ranks ahead of it, all such pairs at once from the left, and the array is compacted until
no pair remains. Reach is the length of the longest piece: whatever merges further away makes
pieces that end before they get here. For words within it that is the segmented minimum of pair
ranks; longer segments take it over a window.

Merging equal pairs at once equals the sequential order only as long as none of these merges
makes a pair that ranks ahead with a neighbour. Where one does, the equal pairs that follow it
within reach wait for the next round.

Defined cases: a null text is the empty text, which encodes to the begin and end ids only
and decodes to the empty text. Characters outside the vocabulary become byte pieces. Only
``doc_id`` and ``text`` are read; every row is encoded, repeated ones too.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import chunks, filled

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHED = 200_000
NONE = np.int64(1 << 40)


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, self.unk, np.int64)
        for i in range(n):
            if lib.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        normal = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        score = {self.pieces[i]: lib.get_score(i) for i in normal}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in score.items()}  # equal scores rank alike: the leftmost wins
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece crosses a word boundary; this model needs whole-text merging")
        self.bytes_of = [b"" if lib.is_control(i) else bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.reach = max(map(len, self.ids))
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        # Merge table over (left id, right id), and the pieces whose merge may make a better pair.
        keys, made, unsafe = [], [], set()
        for p, r in self.rank.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in self.ids and b in self.ids:
                    keys.append((self.ids[a] << 20) | self.ids[b])
                    made.append(self.ids[p])
                    unsafe.update(self.ids[x] for x in (a, b) if len(x) > 1 and self.rank[x] >= r)
        by = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[by], np.array(made, np.int64)[by]
        self.rank_of = np.full(n, NONE, np.int64)
        self.rank_of[[self.ids[p] for p in self.rank]] = list(self.rank.values())
        self.unsafe = np.zeros(n, bool)
        self.unsafe[list(unsafe)] = True

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece id that each pair makes, or -1."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def _symbols(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of single characters (-1: not in the vocabulary), their segments, their code points."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(codes, return_inverse=True)
        ids = np.array([self.ids.get(chr(c), -1) for c in distinct], np.int64)[inverse] if len(codes) else np.zeros(0, np.int64)
        return ids, np.repeat(np.arange(len(segments)), [len(s) for s in segments]), codes

    def _nearest(self, rank: np.ndarray) -> np.ndarray:
        """Minimum of the ranks within reach on either side."""
        out = rank
        for way in (1, -1):
            low, span = rank[::way].copy(), 1
            while span <= self.reach:
                step = min(span, self.reach + 1 - span)
                low[:-step] = np.minimum(low[:-step], low[step:])
                span += step
            out = np.minimum(out, low[::way])
        return out

    def _chosen(self, ids: np.ndarray, segment: np.ndarray, made: np.ndarray, rank: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Those of the pairs ``hit`` that the sequential order would merge before anything else
        changes what is within their reach."""
        # Overlapping equal pairs: from the left every second one, if the first is free to merge.
        again = np.concatenate([[False], (rank[1:] == rank[:-1]) & (segment[1:] == segment[:-1])])
        index = np.arange(len(ids))
        first = np.maximum.accumulate(np.where(again, 0, index))
        where = np.flatnonzero(hit & hit[first] & ((index - first) % 2 == 0))
        if not len(where):
            return where
        # Equal pairs within reach of each other form a row; it is followed as far as pieces are the
        # same and no merge makes a pair with a neighbour that ranks ahead.
        new_row = np.concatenate([[True], (np.diff(where) > self.reach + 2) | (np.diff(segment[where]) != 0) | (np.diff(rank[where]) != 0)])
        row = np.cumsum(new_row) - 1
        lead = where[new_row][row]
        stop = made[where] != made[lead]
        ends = np.zeros(len(where), bool)
        risky = np.flatnonzero(self.unsafe[made[where]])
        if len(risky):
            at = where[risky]
            piece, beside = made[at], np.concatenate([ids, [-1, -1]])
            right = np.where(np.concatenate([segment, [-1, -1]])[at + 2] == segment[at], beside[at + 2], -1)
            merged = np.zeros(len(ids), bool)
            merged[where] = True
            left = np.where((at >= 2) & merged[at - 2], made[at - 2], np.where((at >= 1) & (segment[at - 1] == segment[at]), ids[at - 1], -1))
            pairs = self._merged(np.concatenate([left, piece]), np.concatenate([piece, right]))
            ranks = np.where(pairs >= 0, self.rank_of[pairs], NONE).reshape(2, -1).min(0)
            ends[risky] = ranks <= rank[at]
        # Within a row nothing after the first stop or end.
        over = np.cumsum(stop | np.concatenate([[False], ends[:-1]]))
        return where[over == over[new_row][row]]

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after another, and the number of ids of each."""
        ids, owner, codes = self._symbols(segments)
        ids = np.where(ids < 0, -1 - codes.astype(np.int64), ids)
        lens = np.bincount(owner, minlength=len(segments))
        out_ids, out_owner, out_at = [], [], []
        at = np.arange(len(ids))  # keeps the order of symbols within a segment
        while len(ids):
            same = owner[1:] == owner[:-1]
            made = np.full(len(ids), -1, np.int64)
            made[:-1] = np.where(same, self._merged(ids[:-1], ids[1:]), -1)
            rank = np.where(made >= 0, self.rank_of[made], NONE)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.minimum.reduceat(rank, starts)
            segment = np.cumsum(np.concatenate([[0], ~same]))
            done = best[segment] == NONE
            if done.any():
                out_ids.append(ids[done])
                out_owner.append(owner[done])
                out_at.append(at[done])
            lowest = best[segment]
            wide = np.diff(np.concatenate([starts, [len(ids)]]))[segment] > self.reach
            if wide.any():
                lowest[wide] = self._nearest(rank[wide])
            chosen = self._chosen(ids, segment, made, rank, (rank == lowest) & (rank < NONE))
            ids[chosen] = made[chosen]
            gone = np.zeros(len(ids), bool)
            gone[chosen + 1] = True
            left = ~(gone | done)
            ids, owner, at = ids[left], owner[left], at[left]
        if not out_ids:
            return np.zeros(0, np.int64), lens * 0
        ids, owner, at = map(np.concatenate, (out_ids, out_owner, out_at))
        by = np.lexsort((at, owner))
        ids, owner = ids[by], owner[by]
        # Characters outside the vocabulary: their UTF-8 bytes.
        if (ids < 0).any():
            many = np.ones(len(ids), np.int64)
            chars = {int(c): chr(-1 - c).encode() for c in np.unique(ids[ids < 0])}
            low = np.flatnonzero(ids < 0)
            many[low] = [len(chars[int(c)]) for c in ids[low]]
            ends = np.cumsum(many)
            wide, wide_owner = np.repeat(ids, many), np.repeat(owner, many)
            flat = np.frombuffer(b"".join(chars[int(c)] for c in ids[low]), np.uint8)
            places = np.repeat(ends[low] - many[low], many[low]) + np.arange(len(flat)) - np.repeat(np.cumsum(many[low]) - many[low], many[low])
            wide[places] = self.byte_ids[flat]
            ids, owner = wide, wide_owner
        return ids, np.bincount(owner, minlength=len(segments))

    def _numbered(self, segments: list[str]) -> np.ndarray:
        """Numbers of segments in the cache; new ones are encoded together. The cache holds at
        most CACHED segments and those of one chunk more."""
        if len(self.known) > CACHED:
            self.known.clear()
            self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        known, old = self.known, len(self.known)
        codes = np.fromiter((known.setdefault(s, len(known)) for s in segments), np.int64, len(segments))
        if len(known) > old:
            ids, n = self.encode_segments(list(itertools.islice(known, old, None)))
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
        return codes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the begin and end ids."""
        segments, counts = [], []
        for t in texts:
            if not t:
                found = []
            elif SPACE in t or "  " in t or t[0] == " " or t[-1] == " ":
                found = SEGMENT.findall(SPACE + t.replace(" ", SPACE))
            else:
                found = [SPACE + w for w in t.split(" ")]
            segments += found
            counts.append(len(found))
        codes = self._numbered(segments)
        sizes = self.ends[codes + 1] - self.ends[codes]
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.repeat(self.ends[codes] - total[:-1], sizes) + np.arange(total[-1])]
        cuts = total[np.concatenate([[0], np.cumsum(counts)]).astype(int)]
        return [np.concatenate([[self.bos], flat[a:b], [self.eos]]).astype("<u4") for a, b in zip(cuts[:-1], cuts[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control pieces say nothing, the space put in front is taken off, bytes
        that are not UTF-8 become U+FFFD."""
        pieces = self.bytes_of
        raw = b"".join([pieces[i] for i in ids.tolist()])
        lead = next((i for i in ids.tolist() if pieces[i]), None)
        if lead is not None and self.pieces[lead].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_loaded: dict[str, PieceModel] = {}


def loaded(name: str) -> PieceModel:
    """The model, read once in a worker process; ``name`` is a file sent by SparkContext.addFile."""
    if name not in _loaded:
        _loaded[name] = PieceModel(SparkFiles.get(name))
    return _loaded[name]


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; and the ids and the decoded text if asked for."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(model_path)
    name = model_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(name)
        for batch in batches:
            for part in chunks(batch):
                ids = model.encode(filled(part.column(1)).to_pylist())
                decoded = [model.decode(x) for x in ids]
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
