"""Order-preserving packing of token ids into fixed windows by dynamic programming."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meshlag.llm.util import small_batches, whole_text

END_ID = 1
#: Cost of ending a window inside a document after a sentence, and inside a sentence, in tokens of padding.
SENTENCE_PENALTY, INNER_PENALTY = 16, 64
#: Inside longer sentences a cut is offered every so many ids.
STRIDE = 256
#: Bytes of text that are packed together: distinct words of a group are looked up once.
GROUP_BYTES = 4 << 20

#: Closing marks that may follow a word in a chunk; the apostrophe starts word patterns of its own.
MARKS = ".,!?;:%$&*#|)"
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+"
PLAIN = LETTERS.replace("+", "{1,64}") + r"[.,!?;:%$&*#|)]*$"
#: Columns beside the id.
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Ids of words and of other chunks, learned as they occur and kept side by side in one array.

    The tokenizer drops white space before it forms words, so the ids of a text are those of its chunks. A
    chunk of plain letters with closing marks is split there, where the word pattern also splits, and its
    letters are lower-cased, as the tokenizer does: only lower-case words are kept, and encoded many at a time.
    """

    def __init__(self, tokenizer_file: str, most: int = 500_000, longest: int = 64):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.most, self.longest = most, longest
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes, self.word_end = np.zeros((2, max(vocabulary.values()) + 1), bool)
        self.closes[[i for token, i in vocabulary.items() if token.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)  # entry k has ids starts[k] .. starts[k + 1]
        self.used = 1

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Adds entries whose ids lie side by side; returns the number of the first one."""
        at, n = self.starts[self.used], self.used
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(sizes) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[at : at + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(sizes)] = at + np.cumsum(sizes)
        self.used = n + len(sizes)
        return n

    def learn(self, words: list[str]) -> list[int]:
        """Numbers of new lower-case words of letters. A word's last id, and no other, carries the word-end mark."""
        out: list[int] = []
        for k in range(0, len(words), 8192):
            group = words[k : k + 8192]
            ids = self.encode(" ".join(group))
            stops = np.flatnonzero(self.word_end[ids]) + 1
            if len(stops) != len(group) or stops[-1] != len(ids):  # a letter without an id, say
                each = [self.encode(x) for x in group]
                ids, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
            first = self.append(ids, np.diff(stops, prepend=0))
            out += range(first, first + len(group))
        return out

    def look_up(self, chunks: list[str], plain: bool) -> np.ndarray:
        """Numbers of words of letters (`plain`) or of any chunks."""
        known = self.known
        at = np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0).tolist()
        if plain:
            at[new] = got = self.learn(words := [chunks[k] for k in new])
            known.update(zip(words, got, strict=True))
            return at
        for k in new:
            ids = self.encode(chunks[k])
            at[k] = self.append(ids, np.array([len(ids)]))
            if len(chunks[k]) <= self.longest:
                known[chunks[k]] = int(at[k])
        return at

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, start of each text and the end). Distinct words are looked up once."""
        if self.used > self.most:
            self.forget()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        names = chunks.dictionary
        plain = pc.match_substring_regex(names, PLAIN).to_numpy(zero_copy_only=False)
        chosen = names.filter(pa.array(plain))
        words = pc.utf8_lower(pc.utf8_rtrim(chosen, MARKS)).dictionary_encode()
        tails = pc.replace_substring_regex(chosen, LETTERS, "").dictionary_encode()
        # a chunk is two entries: a word and its marks, or another chunk and the empty one
        pair = np.zeros((len(names), 2), np.int64)
        pair[plain, 0] = self.look_up(words.dictionary.to_pylist(), True)[words.indices.to_numpy()]
        pair[plain, 1] = self.look_up(tails.dictionary.to_pylist(), False)[tails.indices.to_numpy()]
        pair[~plain, 0] = self.look_up(names.filter(pa.array(~plain)).to_pylist(), False)
        picks = pair[chunks.indices.to_numpy()].ravel()
        begins = self.starts[picks]
        lengths = self.starts[picks + 1] - begins
        stops = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(begins - stops[:-1], lengths) + np.arange(stops[-1])]
        return ids, stops[2 * (lists.offsets.to_numpy() - lists.offsets[0].as_py())]


_word_ids: dict[str, WordIds] = {}


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, width: int) -> np.ndarray:
    """Ends of the windows over offered cut `positions` (ascending, gaps <= width, the last one is the end).

    least[j] = min over i with positions[j] - positions[i] <= width of least[i] + padding + penalties[j].
    Padding is width minus the window's length, so the minimum is of least[i] + positions[i] over a sliding
    range: a monotone queue gives it in constant time. Windows whose length is a power of two need none; the
    places where such a window fits are found beforehand.
    """
    xs = np.concatenate([[0], np.asarray(positions, np.int64)])
    ends, begins = [], []
    for k in range(width.bit_length() - 1):
        i = np.searchsorted(xs, xs - (1 << k))
        j = np.flatnonzero(xs[i] == xs - (1 << k))
        ends.append(j)
        begins.append(i[j])
    end, begin = np.concatenate(ends), np.concatenate(begins)
    order = np.argsort(end, kind="stable")
    fits, full = begin[order].tolist(), np.searchsorted(end[order], np.arange(len(xs) + 1)).tolist()
    lowest = np.searchsorted(xs, xs - width).tolist()
    at, extra = xs.tolist(), [0, *np.asarray(penalties).tolist()]
    least, before = [0] * len(at), [0] * len(at)
    keys, queue, head = [0], [0], 0  # least + position, increasing from the head on, and its index
    for j in range(1, len(at)):
        while queue[head] < lowest[j]:
            head += 1
        p, i = at[j], queue[head]
        best = keys[head] + width - p
        for k in fits[full[j] : full[j + 1]]:
            if least[k] < best:
                best, i = least[k], k
        least[j] = best = best + extra[j]
        before[j] = i
        best += p
        while len(keys) > head and keys[-1] >= best:
            keys.pop()
            queue.pop()
        keys.append(best)
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(j)
        j = before[j]
    return xs[out[::-1]]


def offered_cuts(stops: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties): document ends, sentence ends, and every STRIDE ids where none is near.

    `stops` are the ends of the documents, each behind its end id; `closing` are the places behind ids that
    close a sentence. An end id never starts a window of its own.
    """
    sentence = closing[~np.isin(closing, stops - 1)]
    cuts = np.concatenate([stops, sentence])
    order = np.argsort(cuts, kind="stable")
    cuts, costs = cuts[order], np.where(order < len(stops), 0, SENTENCE_PENALTY)
    starts = np.concatenate([[0], cuts[:-1]])
    inner = np.maximum((cuts - starts - (costs == 0) - 1) // STRIDE, 0)
    last = np.cumsum(inner)
    between = np.repeat(starts, inner) + STRIDE * (np.arange(inner.sum()) - np.repeat(last - inner, inner) + 1)
    every = np.concatenate([cuts, between])
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate([costs, np.full(len(between), INNER_PENALTY)])[order]


class Packer:
    """Packs documents group by group. The last window of a group stays open and begins the next group."""

    def __init__(self, words: WordIds, width: int, sequence: int, kind: pa.DataType | None = None):
        self.words, self.width, self.sequence = words, width, sequence
        # what the open window holds: ids, and of each document its id, its ids before, all its ids, and where it stops
        self.ids = np.zeros(0, np.uint32)
        self.doc_ids = pa.array([], kind or pa.int64())
        self.start, self.size, self.stops = np.zeros((3, 0), np.int64)

    def add(self, doc_ids: pa.Array, texts: pa.Array, last: bool = False) -> pa.RecordBatch:
        """The pieces of all closed windows; with `last`, of all."""
        tokens, edges = self.words.of_texts(texts)
        ids = np.concatenate([self.ids, np.insert(tokens, edges[1:], END_ID).astype(np.uint32)])
        sizes = np.diff(edges) + 1
        doc_ids = pa.concat_arrays([self.doc_ids, doc_ids])
        start, size = np.concatenate([self.start, np.zeros_like(sizes)]), np.concatenate([self.size, sizes])
        stops = np.concatenate([self.stops, len(self.ids) + np.cumsum(sizes)])
        closing = np.flatnonzero(self.words.closes[ids]) + 1
        ends = choose_cuts(*offered_cuts(stops, closing), self.width) if len(stops) else np.zeros(0, np.int64)
        shut = ends if last else ends[:-1]
        # pieces lie between the ends of documents and of windows
        reach = shut[-1] if len(shut) else 0
        marks = np.unique(np.concatenate([[0], stops[stops < reach], shut]))
        a, b = marks[:-1], marks[1:]
        doc, window = np.searchsorted(stops, a, "right"), np.searchsorted(shut, a, "right")
        begins = np.concatenate([[0], stops[:-1]])[doc]
        body = memoryview(ids.astype("<u4").tobytes())
        crc = np.fromiter((zlib.crc32(body[x:y]) for x, y in zip((4 * a).tolist(), (4 * b).tolist(), strict=True)), np.int64, len(a))
        opened = np.concatenate([[0], shut])[window]
        columns = [start[doc] + a - begins, b - a, crc, size[doc], self.sequence + window, a - opened]
        names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]
        out = pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), *[pa.array(x.astype(np.int64)) for x in columns]], names)
        self.sequence += len(shut)
        first = int(np.searchsorted(stops, reach, "right"))
        self.ids, self.stops, self.size, self.start = ids[reach:], stops[first:] - reach, size[first:], start[first:]
        if first < len(stops):
            self.start = self.start.copy()
            self.start[0] += max(0, reach - (stops[first - 1] if first else 0))
        self.doc_ids = pa.concat_arrays([doc_ids[first:]])
        return out


def pack_documents(docs: DataFrame, tokenizer_file: str, width: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Documents keep their stored order inside each input partition, which is packed by the task that reads
    it: nothing is shuffled, and a task holds one group of about GROUP_BYTES of text (or its longest document)
    and one open window at a time; only a partition's last window is closed early. Sequence ids hold the
    partition in the high bits, so they are distinct and the same after a retry. A null or empty text is the
    end id alone. Long sentences may be cut every STRIDE ids. Repeated rows and rows that share an id or have
    none are packed one by one; ids keep their type. An empty table gives an empty table; other columns are left out, whatever
    their names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(SCHEMA)])
    kind = to_arrow_schema(schema).field("doc_id").type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _word_ids:
            _word_ids[tokenizer_file] = WordIds(tokenizer_file)
        packer = Packer(_word_ids[tokenizer_file], width, TaskContext.get().partitionId() << 32, kind)
        held: list[pa.RecordBatch] = []
        whole = lambda k: pa.concat_arrays([x.column(k) for x in held])
        for batch in batches:
            held.append(batch)
            if sum(x.column(1).nbytes for x in held) >= GROUP_BYTES:
                yield packer.add(whole(0), whole(1))
                held = []
        yield packer.add(whole(0) if held else pa.array([], kind), whole(1) if held else pa.array([], pa.string()), last=True)

    return rows.mapInArrow(pack, schema)
