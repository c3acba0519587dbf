"""SentencePiece encoding and decoding for merge-type vocabularies (operator 1).

Encoding keeps an agenda of adjacent symbol pairs, ordered by the merged piece's score and then by place: the best pair
merges, its new neighbours join the agenda, until no pair is a piece. As no piece holds the space mark behind another
character, no merge crosses into a word; nor does one cross two neighbours that no piece holds side by side. So words fall
into runs, and the ids of runs and words are remembered while a task lasts, in a bounded number of bytes. Every word that
a task meets for the first time, whatever its length, and one whole text of every slice of an Arrow batch (the one of the
least checksum) are compared with the sentencepiece library; a difference raises.

Null and empty texts have the end id alone and decode to an empty text. Texts are never cut, whatever their length.
Repeated rows give repeated rows; other columns pass through `encode_documents` unless they have an output's name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_bytes, chunks

MARK = "▁"
#: The rank of a pair that is no piece, and the longest run whose agenda is a list.
NEVER, SHORT = 1 << 60, 40
#: Words, and runs of words, that a task remembers, twice over (a young and an old generation); the longest of them.
REMEMBERED, LONGEST = 100_000, 48
#: Bytes of texts that are encoded at a time.
SLICE = 1 << 20


class Memory:
    """The last entries of a table: when the young generation is full it becomes the old one. Entries that are used move
    on, so frequent ones stay."""

    def __init__(self):
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def renewed(self) -> dict[str, str]:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        return self.young


class Pieces:
    """A vocabulary with its merge agenda."""

    def __init__(self, model: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.names = {p: str(i) for p, i in self.ids.items()}
        order = {score: r for r, score in enumerate(sorted({-lib.get_score(i) for i in plain}))}
        self.ranks = {self.pieces[i]: order[-lib.get_score(i)] for i in plain}
        #: what each id shows; nothing for control ids
        self.shown = ["" if lib.is_control(i) else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.values = {i: b for b, i in self.bytes.items()}
        self.end = lib.eos_id()
        #: words are independent if the mark stands only at the front of a piece
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        #: characters that decode to themselves
        self.plain = {p for p in self.ids if len(p) == 1 and p != MARK} | {" "}
        #: neighbours that a merge can join
        self.side_by_side = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self.forget()

    def forget(self) -> None:
        self.known, self.runs = Memory(), Memory()
        #: words that do not decode to themselves
        self.odd: dict[str, str] = {}

    def merge(self, text: str, pairs: list[str]) -> list[str]:
        """The agenda over one run of characters and its neighbouring pairs. That of a short run is a list in the order of
        places, whose least rank comes first; no entry of it is out of date."""
        if len(text) > SHORT:
            return self.merge_long(text)
        symbols, rank = list(text), self.ranks.get
        agenda = [rank(pair, NEVER) for pair in pairs]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            pair = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(pair + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + pair, NEVER)
        return symbols

    def merge_long(self, text: str) -> list[str]:
        """The agenda of a long run is a heap; entries of pairs of which one side has merged since are passed over."""
        symbols, rank = list(text), self.ranks.get
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank(pair, NEVER), i) for i, pair in enumerate(map(add, text, text[1:]))]
        heapify(agenda)
        while agenda:
            best, left = heappop(agenda)
            right = after[left]
            if best == NEVER or right >= n or not symbols[left] or rank(symbols[left] + symbols[right]) != best:
                continue
            symbols[left], symbols[right] = symbols[left] + symbols[right], ""
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                heappush(agenda, (rank(symbols[left] + symbols[nxt], NEVER), left))
            if (prev := before[left]) >= 0:
                heappush(agenda, (rank(symbols[prev] + symbols[left], NEVER), prev))
        return [s for s in symbols if s]

    def encode_run(self, text: str, pairs: list[str]) -> str:
        """Ids of a run, joined by a space."""
        names = self.names
        return " ".join([names[s] if s in names else self.spelled(s) for s in self.merge(text, pairs)])

    def spelled(self, symbol: str) -> str:
        """Ids of a character that is no piece: its bytes, if the vocabulary has them."""
        return " ".join(str(self.bytes[b]) for b in symbol.encode()) if self.bytes else str(self.library.unk_id())

    def encode_word(self, word: str) -> tuple[str, bool]:
        """Ids of a word with its mark: those of its runs, which are cut between characters that no piece joins; and
        whether a run is new."""
        young, old = self.runs.young, self.runs.old
        text = MARK + word.replace(" ", MARK) if " " in word else MARK + word
        pairs = list(map(add, text, text[1:]))
        if self.side_by_side.issuperset(pairs):
            cuts = [(0, len(text))]
        else:
            ends = [i for i, pair in enumerate(pairs, 1) if pair not in self.side_by_side]
            cuts = list(zip([0, *ends], [*ends, len(text)]))
        out, new = [], False
        for a, b in cuts:
            run = text[a:b]
            ids = young.get(run)
            if ids is None:
                ids = old.get(run)
                if ids is None:
                    ids, new = self.encode_run(run, pairs[a : b - 1]), True
                if b - a <= LONGEST and len(cuts) > 1:  # a run that is a whole word is remembered as such
                    young[run] = ids
            out.append(ids)
        return " ".join(out), new

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces join to UTF-8, marks are spaces, the first of which goes; control ids have none."""
        return self.decode_run(ids).removeprefix(" ")

    def decode_run(self, ids: list[int]) -> str:
        values, shown = self.values, self.shown
        if values.keys().isdisjoint(ids):
            return "".join([shown[i] for i in ids])
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in values:
                raw.append(values[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i is not None:
                out.append(shown[i])
        return "".join(out)

    def learn(self, words: list[str]) -> dict[str, str]:
        """Ids of words that are new here. Those with a new run are compared with the library. Those that decode to another
        text are noted in `odd`: only the mark does, and characters that are spelled in bytes may."""
        self.runs.renewed()
        found, fresh = {}, []
        for word in words:
            found[word], new = self.encode_word(word)
            if new and word:
                fresh.append(word)
        for word, expected in zip(fresh, self.library.encode(fresh, num_threads=1)):
            if found[word] != " ".join(map(str, expected)):
                raise ValueError(f"the agenda gives {found[word]} for {word!r}, the library {expected}")
        for word in words:
            if not self.plain.issuperset(word) and (decoded := self.decode_run(list(map(int, found[word].split())))) != " " + word:
                self.odd[word] = decoded
        return found

    def encode_batch(self, batch: list[str]) -> list[tuple[str, str]]:
        """Ids joined by a space, without an end id, and the decoded text of each."""
        split = [self.words(t) for t in batch]
        young, old, odd = self.known.renewed(), self.known.old, self.odd
        if odd:
            odd = self.odd = {w: d for w, d in odd.items() if w in old or w in young}
        new = set().union(*split).difference(young)
        again = {w for w in new if w in old}
        young.update((w, old[w]) for w in again)
        young.update(self.learn(list(new - again)))
        odd, out = self.odd, []
        for text, words in zip(batch, split):
            decoded = text
            if odd and not odd.keys().isdisjoint(words):
                decoded = "".join([odd[w] if w in odd else " " + w for w in words])[1:]
            out.append((" ".join([young[w] for w in words]), decoded))
        for w in [w for w in new if len(w) > LONGEST]:
            del young[w]
            odd.pop(w, None)
        if batch:
            at = min(range(len(batch)), key=lambda i: zlib.crc32(batch[i].encode()))
            expected = self.library.encode(batch[at])
            if out[at] != (" ".join(map(str, expected)), self.library.decode(expected)):
                raise ValueError(f"the agenda differs from the library on {batch[at][:200]!r}")
        return out

    def words(self, text: str) -> list[str]:
        """What stands behind each first space, further spaces in front included; the text itself has one in front."""
        if not text:
            return []
        if not self.by_word:
            return [text]
        if "  " in text or text[0] == " ":
            return [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ")


_LOADED: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """One vocabulary for each worker."""
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def encode_documents(docs: DataFrame, model: str, ids: bool = False, decoded: bool = False, text: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 (see the module), with the ids or the decoded text if asked, and
    without the text if that is not."""
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    added += [T.StructField("ids", T.StringType())] * ids + [T.StructField("decoded", T.StringType())] * decoded
    names = {f.name for f in added}
    kept = [c for c in docs.columns if c not in names]
    here = by_bytes(docs).select(*(f"`{c}`" for c in kept))
    out = [c for c in kept if text or c != "text"]
    schema = T.StructType([*(here.schema[c] for c in out), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        try:
            for batch in chunks(batches, most=SLICE):
                found = p.encode_batch([t or "" for t in batch.column("text").to_pylist()])
                all_ids = [f"{i} {p.end}" if i else str(p.end) for i, _ in found]
                columns = [pa.array([i.count(" ") + 1 for i in all_ids], pa.int64())]
                columns += [pa.array([sha256(i.encode()).hexdigest() for i in all_ids]), pa.array([sha256(d.encode()).hexdigest() for _, d in found])]
                columns += [pa.array(all_ids)] * ids + [pa.array([d for _, d in found])] * decoded
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), *columns], [*out, *(f.name for f in added)])
        finally:
            p.forget()  # the worker goes on to other stages

    return here.mapInArrow(run, schema)
