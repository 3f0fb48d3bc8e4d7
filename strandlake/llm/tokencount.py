"""Token counts by a compiled finite-state transducer.

``compiled`` turns the ranks of a byte-pair vocabulary into a transducer over code points whose transitions carry emitted
token counts: the sum of the emissions along a text is the number of its tokens. An emission is the difference that one more
character makes, so it may be nil or negative (a character that lets pieces merge).

That this is deterministic rests on two facts. The tokens of a prefix end with one token, and what stands before it is
tokenised as if it stood alone; and a sequence of tokens is the right one if each two neighbours are, which the merges along
their common border decide (``Merges.stand``). So the last token at a place follows from the last tokens at the few places
before it from which a piece could reach on. A state is that: the longest end of the text that begins a piece, with the last
token and the count at each of its places. There are finitely many, as pieces are short; they are determinised when first
entered, and the table starts anew when it holds ``most`` of them.

Runs of spaces are states of their own (their pieces merge last and have one rank, so the longest piece comes off a run first
and what is left repeats, which is verified when compiling), and no piece has a space after another character. So every state goes to the same one at the
first space of a run. That makes the state map of a chunk small, wherever it is cut: until that place the chunk continues
what is open at its start (head); from then on the emission is fixed, whatever came before; tail is what is open at its end.
Maps compose associatively (``composed``). Texts of more than a chunk are cut in the plan, their chunks dealt to tasks by
(doc_id, chunk), and the maps, a few words each, reduced in pairs, a level at a time, as in a parallel prefix scan.

The library is used for nothing but reading pieces and ranks from the model's file, on the driver. Null texts count as empty:
no bytes, no tokens. Texts of any length are counted whole. Repeated rows are counted alike, also if they share a doc_id. An
empty table gives none.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from math import inf

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import kept, partitions, rows_of

SPACE = "▁"
CHUNK = 1 << 16
StateMap = tuple[str, int | None, str]
HEAD = re.compile(f"{SPACE}*+[^{SPACE}]*+")


@dataclass(frozen=True)
class Merges:
    """Ranks of the pieces that merges can make (the least goes first), where each falls into two, and the tokens of runs of
    spaces, by length up to one more than the longest piece."""

    ranks: Mapping[str, float]
    halves: Mapping[str, tuple[str, str]]
    spaces: tuple[int, ...]

    def times(self) -> dict[str, list[float]]:
        """For each part, when merges can take it as their left half: each as soon as both halves are there and it is its turn."""
        out: dict[str, set[float]] = {}
        turn = lambda p: self.ranks[p] if p in self.halves else -inf
        for p in self.halves:
            for k in range(1, len(p)):
                x, y = p[:k], p[k:]
                if (k == 1 or x in self.halves) and (len(y) == 1 or y in self.halves):
                    out.setdefault(x, set()).add(max(self.ranks[p], turn(x), turn(y)))
        return {x: sorted(v) for x, v in out.items()}

    def border(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts of a token at its left (0) or right (1) border from one character up, each with the rank of the merge that
        ends it."""
        out, ends = [], inf
        while True:
            out.append((token, ends))
            if token not in self.halves:
                return out[::-1]
            ends = self.ranks[token]
            token = self.halves[token][side]

    def stand(self, left: list[tuple[str, float]], right: list[tuple[str, float]]) -> bool:
        """Whether two tokens stay apart as neighbours, by the right border of one and the left border of the other: no merge
        across comes before both of its parts have gone into larger ones. Of equal ranks the one further left goes first."""
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.ranks.get(x + y)
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if x_ends == y_ends == inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1


def merged(text: str, ranks: Mapping[str, float]) -> list[tuple[str, str | None]]:
    """Tokens by merging, each with the left half of its last merge."""
    parts: list[tuple[str, str | None]] = [(c, None) for c in text]
    while True:
        best, at = inf, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i][0] + parts[i + 1][0], inf)
            if rank < best:
                best, at = rank, i
        if at < 0:
            return parts
        left, right = parts[at][0], parts[at + 1][0]
        parts[at : at + 2] = [(left + right, left)]


def compiled(model: bytes) -> Merges:
    """From the model's file. Refuses models that the transducer doesn't fit."""
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    normal = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_byte(i) or library.is_unknown(i) or library.is_unused(i))]
    score = {library.id_to_piece(i): library.get_score(i) for i in normal}
    runs = {p: -s for p, s in score.items() if len(p) > 1 and not p.strip(SPACE)}
    if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) for p in score.keys() - runs):
        raise ValueError("a piece has a space after another character")
    longest = max(map(len, runs), default=1)
    sizes = [len(merged(SPACE * k, runs)) for k in range(4 * longest + 2)]
    if any(n != k // longest + sizes[k % longest] for k, n in enumerate(sizes)):
        raise ValueError("runs of spaces aren't cut into the longest pieces first")
    words = {p: -s for p, s in score.items() if p not in runs}
    if runs and max(r for p, r in words.items() if len(p) > 1) >= min(runs.values()):
        raise ValueError("runs of spaces merge before other pieces")
    halves = {}
    for p in words:
        parts = merged(p, words)
        if len(parts) == 1 and len(p) > 1:
            halves[p] = (parts[0][1], p[len(parts[0][1]) :])
    if len(library.encode("a")) == len(library.encode(" a")):
        raise ValueError("the model drops or merges spaces: it isn't one that keeps its input")
    return Merges({p: r for p, r in words.items() if p in halves or len(p) == 1}, halves, tuple(sizes[: longest + 2]))


class State(dict):
    """Character: (next state, emitted). ``text``: the longest end that begins a piece. ``ends``: for each end that does, and the
    empty one, its length, the last token before it (None: the word begins there, with its space), the count there less that
    of the whole, and whether the word's first token is the bare space. ``bare``: what a first token other than the bare space
    costs more, by the run of spaces before it. ``run``: spaces so far, if there is nothing else, less whole longest pieces."""

    __slots__ = ("bare", "ends", "machine", "run", "text")

    def __missing__(self, c: str) -> tuple[State, int]:
        out = self[c] = self.machine.step(self, c)
        return out


class Transducer:
    def __init__(self, merges: Merges, most: int = 300_000):
        self.merges, self.most = merges, most
        self.begun = {p[:k] for p in merges.halves for k in range(1, len(p))}
        self.times = merges.times()
        self.like: dict[str, str] = {}
        self.kinds: dict[tuple, str] = {}
        self.lefts: dict[str, list[tuple[str, float]]] = {}
        self.rights: dict[str, list[tuple[str, float]]] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.states: dict[object, State] = {}
        self._restart()

    def _restart(self) -> None:
        for state in self.states.values():
            state.clear()  # they refer to one another
        self.states = {}
        self.start = self._state("", (), 0, 0)
        for memo in (self.apart, self.lefts, self.rights):
            if len(memo) > 2 * self.most:
                memo.clear()

    def _state(self, text: str, ends: tuple, bare: int, run: int) -> State:
        key = (text, ends, bare, run)
        out = self.states.get(key)
        if out is None:
            out = State()
            out.machine, out.text, out.ends, out.bare, out.run = self, text, ends, bare, run
            self.states[key] = out
        return out

    def _spaces(self, run: int) -> State:
        """After so many spaces, the last of which a word may take."""
        sizes = self.merges.spaces
        run = run % (len(sizes) - 2) or len(sizes) - 2
        return self._state(SPACE, ((1, None, -1, False), (0, SPACE, 0, sizes[run - 1] + 1 > sizes[run])), sizes[run - 1] + 1 - sizes[run], run)

    def _stand(self, a: str, b: str) -> bool:
        out = self.apart.get((a, b))
        if out is None:
            left = self.rights.get(a)
            if left is None:
                left = self.rights[a] = self.merges.border(a, 1)
            right = self.lefts.get(b)
            if right is None:
                right = self.lefts[b] = self.merges.border(b, 0)
            out = self.apart[a, b] = self.merges.stand(left, right)
        return out

    def _kind(self, token: str) -> str:
        """The first token seen that no following one tells from this: of its right border, the parts that merges can take
        across end at the same time as seen by those merges."""
        out = self.like.get(token)
        if out is None:
            key = tuple((x, bisect_left(self.times[x], ends)) for x, ends in self.merges.border(token, 1) if x in self.times)
            out = self.like[token] = self.kinds.setdefault(key, token)
        return out

    def step(self, state: State, c: str) -> tuple[State, int]:
        if c == SPACE:
            sizes = self.merges.spaces
            return self._spaces(state.run + 1), sizes[state.run + 1] - sizes[state.run]
        text, halves, begun = state.text + c, self.merges.halves, self.begun
        token, open_ends = "", []
        for reach, before, count, bare in state.ends:
            piece = text[-1 - reach :]
            if not token and (not reach or piece in halves) and (before is None or self._stand(before, piece)):
                token, more, is_bare = piece, count, bare and before is not None
            if piece in begun:
                open_ends.append((reach + 1, before, count, bare))
        if not token:
            raise AssertionError("no token can end here")
        more += 1 if len(token) > 1 or token in self.merges.ranks else len(token.encode("utf-8", "surrogatepass"))
        emitted = more + state.bare * (state.ends[-1][3] - is_bare)
        ends = (*[(r, t, n - more, b) for r, t, n, b in open_ends], (0, self._kind(token), 0, is_bare and state.bare > 0))
        return self._state(text[-open_ends[0][0] :] if open_ends else "", ends, state.bare, 0), emitted

    def run(self, text: str) -> int:
        """Emitted from the start, which every state is like before a space. ``text`` begins with a space mark or is empty."""
        if len(self.states) > self.most:
            self._restart()
        state, total = self.start, 0
        for c in text:
            state, n = state[c]
            total += n
        return total

    def state_map(self, chunk: str) -> StateMap:
        """(head, emitted, tail); emitted None: nothing in the chunk makes its states agree, all of it is head."""
        first = HEAD.match(chunk).end()
        if first == len(chunk):
            return chunk, None, ""
        last = last_run(chunk)
        return chunk[:first], self.run(chunk[first:last]), chunk[last:]

    def composed(self, left: StateMap, right: StateMap) -> StateMap:
        """Of two neighbouring chunks. A run of spaces or a word that the cut parts is joined again."""
        (head, before, tail), (ahead, after, end) = left, right
        if before is None:
            joint = self.state_map(head + ahead)
            if after is None:
                return joint
            return joint[0], after + (0 if joint[1] is None else joint[1] + self.run(joint[2])), end
        joint = tail + ahead
        if after is None:
            at = last_run(joint)
            return head, before + self.run(joint[:at]), joint[at:]
        return head, before + self.run(joint) + after, end

    def total(self, maps: list[StateMap]) -> int:
        """Of the chunks of a whole text, in order: reduced in pairs, a level at a time."""
        while len(maps) > 1:
            maps = [self.composed(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, emitted, tail = maps[0]
        return self.run(head) + (0 if emitted is None else emitted + self.run(tail))


def last_run(text: str) -> int:
    """Where the last run of spaces begins."""
    at = text.rfind(SPACE)
    while at and text[at - 1] == SPACE:
        at -= 1
    return at


def marked(text: str, first: bool) -> str:
    """With marks for spaces, and one before a text's first character."""
    return (SPACE if first and text else "") + text.replace(" ", SPACE)


COUNTS_DDL = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
MAPS_DDL = "doc_id bigint, text_hash bigint, n_bytes bigint, chunk int, head string, emitted bigint, tail string"


def count_tokens(spark: SparkSession, docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. Texts of over ``chunk`` characters are counted by their chunks in many tasks."""
    with open(model_path, "rb") as f:
        merges = spark.sparkContext.broadcast(compiled(f.read()))  # the vocabulary: a few megabytes
    key = uuid.uuid4().hex
    machine = lambda: kept("transducer", key, lambda: Transducer(merges.value))

    def counted(ids: list, sizes: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=COUNTS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = machine()
        for ids, sizes, texts in rows_of(batches):
            if ids:
                yield counted(ids, sizes, [of.run(marked(t, True)) for t in texts])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = machine()
        for *keys, chunks, parts in rows_of(batches, 16):
            if chunks:
                maps = zip(*(of.state_map(marked(t, not at)) for at, t in zip(chunks, parts, strict=True)), strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*keys, chunks, *maps), kinds, strict=True)], names=[x.split()[0] for x in MAPS_DDL.split(", ")])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = machine()
        for ids, sizes, maps in rows_of(batches, 16):
            if ids:
                yield counted(ids, sizes, [of.total([(m["head"], m["emitted"], m["tail"]) for m in row]) for row in maps])

    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    long = F.length("text") > chunk
    short = source.filter(~long).mapInArrow(whole, COUNTS_DDL)
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))).alias("chunk")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int")), lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk)))
    row = ["doc_id", "text_hash", "n_bytes"]
    cut = source.filter(long).select("doc_id", F.xxhash64("text").alias("text_hash"), "n_bytes", F.posexplode(pieces).alias("chunk", "part"))
    maps = cut.repartition(partitions(spark), "doc_id", "text_hash", "chunk").mapInArrow(mapped, MAPS_DDL)
    # rows that are equal have equal maps: one of them is reduced, and counted as often as there are rows
    once = maps.groupBy(*row, "chunk").agg(F.count("*").alias("rows"), F.any_value(F.struct("head", "emitted", "tail")).alias("m"))
    texts = once.groupBy(*row).agg(F.max("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("maps"))  # a text's own length
    copies = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    counts = texts.select("doc_id", "n_bytes", F.transform("maps", lambda x: x["m"]).alias("maps"), copies.alias("copy")).drop("copy").mapInArrow(reduced, COUNTS_DDL)
    return short.union(counts)
