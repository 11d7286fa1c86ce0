"""Repair of conversation structure by a grammar-compressed dynamic programme.

A conversation's rows become symbols of role and fault.  The cheapest edits that
make the roles alternate are a path through four states (start, after a system row,
after a user row, after an assistant row), and a symbol is a matrix over them: the
least cost from one state to another, and the edits of it.  Matrices multiply by
(min, +), and of equal costs the edits that sort first win; they are kept as ropes, so
a product copies none.

Many conversations share stretches of symbols.  Re-Pair replaces the most frequent
pairs of neighbouring symbols by new ones, again and again, in rounds over all
distinct sequences: a round counts pairs (combined before the shuffle) and takes the
most frequent ones that cannot overlap.  Each rule's matrix is one product of its
two symbols' matrices, evaluated bottom-up once in each worker, and every
conversation is then a short product.

Sizes.  Rows are sorted by ranges, so a long conversation spreads over tasks, and
their symbols are gathered in blocks of 4,096 rows.  A conversation's symbols and
edits are one cell of the result, a byte for each row.  Its digest is one SHA-256
stream, whose rows pass through a task one at a time.

Defined cases: a null id, turn, role or text is damaged as one space; null turns come
first and do not count as turns, and rows of a null id are a conversation; rows of one
turn go in the order of role and of the SHA-256 of the text, after the damage; repeated
rows are all taken (the later ones are duplicates); empty texts are blank; very long
texts are taken whole; an empty table gives no rows; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.skew import join_hot
from quarry.llm.storage import materialize

#: Costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a block as a power of two; pairs that a round counts as candidates; rounds.
BLOCK_BITS, PAIRS, ROUNDS = 12, 256, 16
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Role initials as numbers; any other is the last.
INITIALS = "sua"
#: A row's code is a letter for (initial, fault); blank and duplicate rows are one symbol.
CODES = [chr(65 + 4 * k + f) for k in range(4) for f in range(4)]
GONE = "x"
_GONE_CODES = "".join(CODES[4 * k + f] for k in range(4) for f in (BLANK, DUPLICATE))
TERMINALS = sorted(set(CODES) - set(_GONE_CODES)) + [GONE]

#: States of ``(s?(ua)+)?``: the start, after s, after u, after a; the first and the last accept.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
NAMES = {"u": "user", "a": "assistant"}


class Rope:
    """Edits in order: a string, or two ropes."""

    __slots__ = ("left", "right", "_text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self._text, self.left, self.right = text, left, right

    def text(self) -> str:
        if self._text is None:
            self._text = self.left.text() + self.right.text()
        return self._text


#: A matrix: for (state before, state after), the least cost and its edits.
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def _better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    """Less cost, or edits that sort first.

    Edits of one cost over the same rows never begin with one another (they would
    differ by insertions, which cost), so this order survives what follows them.
    """
    return old is None or new[0] < old[0] or (new[0] == old[0] and new[1].text() < old[1].text())


def product(one: Matrix, two: Matrix) -> Matrix:
    out: Matrix = {}
    for (p, m), (cost, rope) in one.items():
        for q in range(4):
            if (m, q) in two:
                way = (cost + two[m, q][0], Rope(None, rope, two[m, q][1]))
                if _better(way, out.get((p, q))):
                    out[p, q] = way
    return out


def _insertions() -> Matrix:
    """The cheapest insertions from each state to each."""
    out: Matrix = {(p, p): (0, Rope("")) for p in range(4)}
    for _ in range(3):
        for (p, m), (cost, rope) in list(out.items()):
            for initial in NAMES:
                if (q := STEPS.get((m, initial))) is not None:
                    way = (cost + INSERT, Rope(rope.text() + "I"))
                    if _better(way, out.get((p, q))):
                        out[p, q] = way
    return out


def terminal(symbol: str) -> Matrix:
    """Insertions, then one row kept, given a role or deleted."""
    row: Matrix = {(p, p): (DELETE, Rope("D")) for p in range(4)}
    if symbol != GONE:
        kind, fault = divmod(ord(symbol) - 65, 4)
        own, more = (INITIALS + "?")[kind], TRUNCATED if fault == CUT else 0
        for (p, initial), q in STEPS.items():
            edit = (KEEP + more, Rope("K")) if initial == own else (REROLE + more, Rope("R"))
            if (initial == own or initial in NAMES) and _better(edit, row.get((p, q))):
                row[p, q] = edit
    return product(_insertions(), row)


class Grammar:
    """Rules by rounds: a round has pairs of earlier symbols and the symbols that stand for them."""

    def __init__(self, rounds: list[list[tuple[int, int]]]):
        self.matrices = [terminal(t) for t in TERMINALS]
        self.rounds = []
        for pairs in rounds:
            first = len(self.matrices)
            # Bottom-up: a rule has symbols of earlier rounds only.
            self.matrices += [product(self.matrices[a], self.matrices[b]) for a, b in pairs]
            keys = np.array([a << 32 | b for a, b in pairs], np.int64)
            order = np.argsort(keys)
            self.rounds.append((keys[order], first + order))
        self.end = _insertions()

    def compress(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of all sequences, which -1 separates, after all rounds."""
        for keys, names in self.rounds:
            pair = pair_keys(symbols)
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == pair)
            # Neighbouring hits are runs of one symbol, replaced from their left.
            new = np.concatenate([[True], np.diff(hit) != 1]) if len(hit) else np.zeros(0, bool)
            begin = hit[np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))] if len(hit) else hit
            hit = hit[(hit - begin) % 2 == 0]
            symbols = symbols.copy()
            symbols[hit] = names[at[hit]]
            symbols = np.delete(symbols, hit + 1)
        return symbols

    def solve(self, symbols: np.ndarray) -> tuple[int, str]:
        """The least cost of a sequence and its edits."""
        # A way is its cost, the way before it and its last edits.
        ways: dict[int, tuple] = {START: (0, None, Rope(""))}
        for symbol in symbols.tolist():
            ways = self._on(ways, self.matrices[symbol])
        ways = self._on(ways, self.end)
        best = [ways[q] for q in (START, AFTER_A) if q in ways]
        way = best[0] if len(best) == 1 or self._sooner(best[0], best[1]) else best[1]
        edits, cost = [], way[0]
        while way is not None:
            edits.append(way[2].text())
            way = way[1]
        return cost, "".join(reversed(edits))

    def _on(self, ways: dict[int, tuple], matrix: Matrix) -> dict[int, tuple]:
        out: dict[int, tuple] = {}
        for (p, q), (cost, rope) in matrix.items():
            if p in ways:
                way = (ways[p][0] + cost, ways[p], rope)
                if q not in out or self._sooner(way, out[q]):
                    out[q] = way
        return out

    @staticmethod
    def _sooner(one: tuple, two: tuple) -> bool:
        if one[0] != two[0]:
            return one[0] < two[0]
        edits: tuple[list[str], list[str]] = ([], [])
        while one is not two:  # both have as many steps
            edits[0].append(one[2].text())
            edits[1].append(two[2].text())
            one, two = one[1], two[1]
        return "".join(reversed(edits[0])) < "".join(reversed(edits[1]))


def pair_keys(symbols: np.ndarray) -> np.ndarray:
    """Neighbouring symbols as one number, negative where a sequence ends."""
    return np.where((symbols[:-1] >= 0) & (symbols[1:] >= 0), symbols[:-1] << 32 | symbols[1:], -1)


_NUMBERS = np.full(128, -1, np.int64)
for _k, _t in enumerate(TERMINALS):
    _NUMBERS[ord(_t)] = _k


def _symbols(sequences: list[str]) -> np.ndarray:
    return _NUMBERS[np.frombuffer(("\n".join([*sequences, ""])).encode(), np.uint8)]


def choose_pairs(counted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs by falling frequency, those that cannot overlap: no symbol is first in one and second in another."""
    firsts, seconds, chosen = set(), set(), []
    for key, _ in counted:
        a, b = key >> 32, key & 0xFFFFFFFF
        if a in seconds or b in firsts or (a == b and (a in firsts or b in seconds)):
            continue
        firsts.add(a)
        seconds.add(b)
        chosen.append((a, b))
    return chosen


_held: dict[str, Grammar] = {}


def _grammar(rounds: list[list[tuple[int, int]]]) -> Grammar:
    """The worker's grammar, evaluated once."""
    if (name := repr(rounds)) not in _held:
        _held.clear()
        _held[name] = Grammar(rounds)
    return _held[name]


def induce(sequences: DataFrame, pairs: int = PAIRS, rounds: int = ROUNDS) -> list[list[tuple[int, int]]]:
    """Re-Pair rounds over all rows of ``sequences`` (seq); the driver sees at most ``pairs`` pairs of a round."""
    found: list[list[tuple[int, int]]] = []
    for _ in range(rounds):

        def count(batches: Iterable[pa.RecordBatch], known: list = found) -> Iterator[pa.RecordBatch]:
            grammar = _grammar(known)
            for b in batches:
                key, n = np.unique(pair_keys(grammar.compress(_symbols(b.column(0).to_pylist()))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

        counted = sequences.select("seq").mapInArrow(count, "pair long, n long").filter(F.col("pair") >= 0).groupBy("pair").agg(F.sum("n").alias("n"))
        top = counted.filter(F.col("n") > 1).orderBy(F.desc("n"), "pair").limit(pairs).collect()
        if not top:
            break
        found = [*found, choose_pairs([tuple(r) for r in top])]
    return found


def solutions(sequences: DataFrame, rounds: list[list[tuple[int, int]]]) -> DataFrame:
    """(seq, cost, audit) of each distinct sequence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = _grammar(rounds)
        for b in batches:
            symbols = grammar.compress(_symbols(b.column(0).to_pylist()))
            parts = np.split(symbols, np.flatnonzero(symbols < 0) + 1)[:-1]
            cost, audit = zip(*(grammar.solve(p[:-1]) for p in parts), strict=True) if parts else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["seq", "cost", "audit"])

    return sequences.select("seq").mapInArrow(run, "seq string, cost long, audit string")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (none for a dropped row) of each row."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat_ws(":", or_space("conv_id"), or_space("turn"))) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(or_space("text"), STOPS, "")).otherwise(or_space("text"))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(case == 4, "user").otherwise(or_space("role")).alias("role"),
        text.alias("text"), F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text"), 256))


def sequences(damaged: DataFrame) -> DataFrame:
    """(conv_id, codes, seq): the codes of each conversation's rows, in order, and their symbols."""
    initial = F.substring("role", 1, 1)
    kind = F.lit(len(INITIALS))
    for k, c in enumerate(INITIALS):
        kind = F.when(initial == c, k).otherwise(kind)
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(F.substring(body, -1, 1).isin(*STOPS), NONE).otherwise(CUT)
    slim = damaged.filter(F.col("copies") > 0).select(
        "conv_id", "turn", "role", _digest().alias("digest"), kind.alias("kind"), fault.alias("fault"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")
    )
    # The last key parts equal rows, which may lie in any order.
    keys = ["conv_id", "turn", "role", "digest"]
    dealt = slim.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys, "copy").sortWithinPartitions(*keys)
    lines = materialize(dealt.select("conv_id", "role", "digest", "kind", "fault", F.monotonically_increasing_id().alias("at")), "conversation-lines")
    first = lines.filter(F.col("fault") != BLANK).groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    seen = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    coded = lines.join(first, "at", "left").select("conv_id", "at", F.char(65 + 4 * F.col("kind") + seen).alias("code"))
    blocks = coded.groupBy("conv_id", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("rows"))
    joined = blocks.select("conv_id", "block", F.array_join("rows.code", "").alias("codes"))
    whole = joined.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "codes"))).alias("blocks"))
    codes = whole.select("conv_id", F.array_join("blocks.codes", "").alias("codes"))
    return codes.withColumn("seq", F.translate("codes", _GONE_CODES, GONE * len(_GONE_CODES)))


_PLAIN = str.maketrans({c: (INITIALS + "o")[k // 4] for k, c in enumerate(CODES)})


class _Reader:
    """One conversation as its rows pass."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.cost, self.audit, self.at, self.state = conv_id, "", 0, "", 0, START
        self.least = self.last = None
        self.turns, self.rows, self.hash = 0, 0, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.rows else "") + role + ":").encode())
        self.hash.update(text.encode())
        self.rows += 1

    def _edit(self, role: str, text: str) -> bool:
        """The next edit; whether it took the row."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return True
        initial = role[:1] if edit == "K" else "a" if self.state == AFTER_U else "u"
        self._write(role if edit == "K" else NAMES[initial], "" if edit == "I" else text)
        self.state = STEPS[self.state, initial]
        return edit != "I"

    def row(self, turn: int | None, role: str, text: str, copies: int) -> None:
        if copies and turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last, self.turns = turn, self.turns + 1
        for _ in range(copies):
            while not self._edit(role, text):
                pass

    def result(self) -> tuple:
        while self.at < len(self.audit):
            self._edit("", "")
        kinds = self.codes.translate(_PLAIN)
        illegal = max(0, len(kinds) - 1) - sum(map(kinds.count, ("su", "ua", "au")))
        faults = [sum(self.codes.count(CODES[4 * k + f]) for k in range(4)) for f in (BLANK, DUPLICATE, CUT)]
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return (self.conv_id, gaps, *faults, illegal, self.cost, self.audit, self.hash.hexdigest())


_COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation: first its codes, cost and edits, if it has rows, then its rows in order."""
    done, now, kind = [], None, None

    def rows() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _COLUMNS)

    for b in batches:
        kind = b.schema.field(0).type
        for conv_id, turn, role, text, copies, codes, cost, audit in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.result())
                if len(done) == 1000:
                    yield rows()
                    done = []
                now = _Reader(conv_id)
            if audit is None:
                now.row(turn, role, text, copies)
            else:
                now.codes, now.cost, now.audit = codes, cost, audit
    if now is not None:
        done.append(now.result())
        yield rows()


def repair(rows: DataFrame, pairs: int = PAIRS, rounds: int = ROUNDS) -> DataFrame:
    """A row for each conversation of ``rows``: its faults, and the cheapest edits that mend it."""
    damaged = damage(rows)
    found = materialize(sequences(damaged), "conversations")
    distinct = materialize(found.select("seq").distinct(), "sequences")
    solved = materialize(solutions(distinct, induce(distinct, pairs, rounds)), "solutions")
    heads = join_hot(found, solved, "seq")
    nothing = {"digest": "binary", "codes": "string", "cost": "long", "audit": "string", "turn": "long", "role": "string", "text": "string", "copies": "int"}
    order = ["conv_id", "turn", "role", "text", "copies", "codes", "cost", "audit"]
    rows = damaged.withColumn("digest", _digest()).withColumns({c: F.lit(None).cast(nothing[c]) for c in ("codes", "cost", "audit")})
    heads = heads.withColumns({c: F.lit(None).cast(nothing[c]) for c in ("turn", "role", "digest", "text", "copies")})
    both = rows.select(*order, "digest").unionByName(heads.select(*order, "digest"))
    sort = ["conv_id", F.col("audit").isNull(), "turn", "role", "digest"]
    kind = damaged.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COLUMNS[1:7]) + ", audit string, repaired_sha256 string"
    return both.repartition("conv_id").sortWithinPartitions(*sort).select(*order).mapInArrow(_repaired, schema)
