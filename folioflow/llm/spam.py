"""Keyword-stuffed and link-list pages, by a hidden Markov model over a page's lines.

A page is a sequence of units, its lines, long ones cut at sentence ends. Each unit emits one of a few symbols, which
depend on common words, addresses, tag syntax, separators, numbers and on how much of the unit are words that make up an
unusual share of the whole page. Hidden states are prose, link list, tag list, menu and record (rows of tables, contents,
references: no sentences, yet no spam). The model is trained by expectation maximisation on all pages; the most likely states come from
Viterbi's algorithm, run in step over the pages of a batch; a page is spam if more than half of its words are in link lists, tag lists and menus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.storage import materialize, spread

WORD = re.compile(r"[^\W_]+")
ADDRESS = re.compile(r"https?://|www\.|<a\s|\]\(|\b[\w-]+\.[a-z]{2,7}(?:/|\s*[);,]|\s*$)", re.I)
#: An address or the markup of a link; what remains of a line is its own text.
LINK = re.compile(r"<a\s[^>]*>|</a>|<br>|\(?(?:https?://|www\.)[^\s<>()\"]+\)?|\b[\w-]+\.[a-z]{2,7}(?:/\S*)?", re.I)
TAGS = re.compile(r"#\w{2,}|\b[\w-]{2,20}=[^\s;,]", re.I)
CODE = re.compile(r"^\s*[A-Z]{2,4}-\d+\s+\D*\d+[.,]\d\d\b")
LABELLED = re.compile(r"^\s*[^\W\d_][^:,.]{1,24}:\s[^,]{1,40},[^,]{1,40},")
RECORD = re.compile(r"^\s*(?:\[\d+\]|\d+(?:\.\d+)+\s)|\.{4,}\s*\d+\s*$|^\s*\|?\s*:?-{3,}")
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
SEPARATOR = re.compile(r"[\t|;»·•]| {2,}|\s/\s|\s[-–—]\s|,")
END = re.compile(r"[.!?…:][\"'”’»)\]]*\s*$")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")
QUOTED = re.compile(r"^\s*>+ ?")
LONG, CUT = 240, 40
STATES = ("prose", "links", "tags", "menu", "record")
SENTENCE_, PLAIN, ADDRESSED, REPEATED, TAGGED, TITLE, ROW, OTHER = range(8)

# The model before training, which is also what training is held to. Probability of each symbol above in each
# state; of staying in a state; of the first.
EMISSION = np.array(
    [
        # sentence plain  address repeat tagged title  row    other
        [0.80, 0.12, 0.010, 0.010, 0.005, 0.020, 0.015, 0.020],
        [0.02, 0.04, 0.800, 0.040, 0.010, 0.060, 0.010, 0.020],
        [0.02, 0.04, 0.010, 0.500, 0.350, 0.040, 0.020, 0.020],
        [0.02, 0.04, 0.060, 0.060, 0.020, 0.730, 0.020, 0.050],
        [0.08, 0.10, 0.010, 0.010, 0.010, 0.040, 0.720, 0.030],
    ]
)
STAY, FIRST = 0.86, np.array([0.6, 0.1, 0.1, 0.1, 0.1])
#: Rounds of training; units that each state's prior counts for.
ROUNDS, HELD = 6, 2000
#: Units of a block, by which long pages advance at once; units whose probabilities are kept at once (some 100 MB), unless one
#: page has more; parts of a unit that counts are rounded to, so that their sum doesn't depend on its order.
BLOCK, AT_ONCE, PARTS = 256, 1_000_000, 1 << 20


@dataclass(frozen=True)
class Model:
    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def untrained() -> Model:
    k = len(STATES)
    return Model(FIRST, np.where(np.eye(k, dtype=bool), STAY, (1 - STAY) / (k - 1)), EMISSION / EMISSION.sum(1, keepdims=True))


def expected(flat: np.ndarray, sizes: np.ndarray, model: Model, block: int = BLOCK) -> Model:
    """Expected counts of first states, moves and emissions over whole sequences (Baum-Welch's first half). ``flat`` holds their
    symbols one after another, ``sizes`` how many each has.

    All blocks of all sequences advance together. A sequence of several blocks first multiplies the steps of each, which says
    what comes into it from those before and from those behind: counts are those of the uncut sequence.
    """
    k, emit, move = len(STATES), model.emit.T, model.move
    sizes, blocks = sizes[sizes > 0], -(-sizes[sizes > 0] // block)
    counts = np.zeros(k), np.zeros((k, k)), np.zeros_like(emit)
    if not len(sizes):
        return Model(counts[0], counts[1], counts[2].T)
    ordinal = np.arange(blocks.sum()) - np.repeat(blocks.cumsum() - blocks, blocks)
    start = np.repeat(sizes.cumsum() - sizes, blocks) + ordinal * block
    size = np.minimum(block, np.repeat(sizes, blocks) - ordinal * block)
    last = ordinal == np.repeat(blocks, blocks) - 1
    into, behind = np.tile(model.first, (len(size), 1)), np.ones((len(size), k))
    if len(cut := np.flatnonzero(np.repeat(blocks, blocks) > 1)):
        cut = cut[np.argsort(-size[cut], kind="stable")]
        through = np.tile(np.eye(k), (len(cut), 1, 1))
        for t in range(int(size[cut[0]])):
            n = int(np.searchsorted(-size[cut], -t, "left"))
            through[:n] = (through[:n] * emit[flat[start[cut[:n]] + t]][:, None, :]) @ move
            through[:n] /= through[:n].sum((1, 2), keepdims=True)
        through = dict(zip(cut.tolist(), through))
        for i in sorted(through):
            if not last[i]:
                x = into[i] @ through[i]
                into[i + 1] = x / x.sum()
        for i in sorted(through, reverse=True):
            if not last[i]:
                x = through[i + 1] @ behind[i + 1]
                behind[i] = x / x.sum()
    order = np.argsort(-size, kind="stable")
    start, size, into, behind, opens, last = start[order], size[order], into[order], behind[order], ordinal[order] == 0, last[order]
    alive = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]  # blocks longer than t
    alpha = []
    for t, n in enumerate(alive):
        x = (alpha[-1][:n] @ move if t else into) * emit[flat[start[:n] + t]]
        alpha.append(x / x.sum(1, keepdims=True))
    beta, to = behind @ move.T, np.eye(emit.shape[0])

    def moved(here: np.ndarray, there: np.ndarray) -> np.ndarray:
        weight = there @ move.T
        counts[1][...] += move * (here.T @ (there / (here * weight).sum(1, keepdims=True)))
        return weight / weight.sum(1, keepdims=True)

    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        seen = flat[start[:n] + t]
        state = alpha[t] * beta[:n]
        state /= state.sum(1, keepdims=True)
        counts[2][...] += to[seen].T @ state
        if n > (longer := alive[t + 1] if t + 1 < len(alive) else 0) and (on := ~last[longer:n]).any():
            moved(alpha[t][longer:][on], behind[longer:n][on])
        if t:
            beta[:n] = moved(alpha[t - 1][:n], emit[seen] * beta[:n])
        else:
            counts[0][...] += state[opens].sum(0)
    return Model(counts[0], counts[1], counts[2].T)


def fitted(counts: Model, held: float = HELD) -> Model:
    """The model that expected counts give, with the untrained one's probabilities as ``held`` units of each state."""
    prior = untrained()
    return Model(*((n + held * p) / (n + held * p).sum(-1, keepdims=True) for n, p in ((counts.first, prior.first), (counts.move, prior.move), (counts.emit, prior.emit))))


def train(sequences: list[list[int]], rounds: int = ROUNDS, held: float = HELD) -> Model:
    """Expectation maximisation (Baum-Welch) over all sequences at once, from the untrained model, which also is the prior."""
    model = untrained()
    flat, sizes = np.array([x for s in sequences for x in s], np.int64), np.array([len(s) for s in sequences], np.int64)
    for _ in range(rounds if len(flat) else 0):
        model = fitted(expected(flat, sizes, model), held)
    return model


def _counts(model: Model):
    """The expected counts of a task's pages, cell by cell, in whole parts of a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            column = batch.column(0).cast(pa.binary())
            ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
            flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            begin = 0
            while begin < len(column):
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + AT_ONCE, "right")) - 1)
                found = expected(flat[ends[begin] : ends[end]], np.diff(ends[begin : end + 1]), model)
                total = total + np.rint(np.concatenate([x.ravel() for x in (found.first, found.move, found.emit)]) * PARTS).astype(np.int64)
                begin = end
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["cell", "parts"])

    return run


def train_on(pages: DataFrame, rounds: int = ROUNDS, held: float = HELD) -> Model:
    """:func:`train` on every row of ``pages``, whose column ``symbols`` has a byte a unit. Each round is a pass over them;
    the driver gets one sum for each cell of the model."""
    model = untrained()
    cuts = np.cumsum([model.first.size, model.move.size])
    for _ in range(rounds):
        sums = pages.select("symbols").mapInArrow(_counts(model), "cell int, parts long").groupBy("cell").agg(F.sum("parts").alias("parts")).collect()
        if not sums:
            break
        first, move, emit = np.split(np.array([r["parts"] for r in sorted(sums, key=lambda r: r["cell"])]) / PARTS, cuts)
        model = fitted(Model(first, move.reshape(model.move.shape), emit.reshape(model.emit.shape)), held)
    return model


def _wrapped(lines: list[str], common: frozenset[str]) -> bool:
    """Whether the lines of a block are a paragraph with hard line breaks."""
    if len(lines) < 2 or not END.search(lines[-1]) or sum(bool(END.search(x)) for x in lines) > 0.6 * len(lines):
        return False
    block = "\n".join(lines)
    words = WORD.findall(block.lower())
    return sum(w in common for w in words) >= 0.2 * len(words) and not ADDRESS.search(block) and not TAGS.search(block)


def units(text: str, common: frozenset[str]) -> list[str]:
    """Lines, or sentences where lines are long or only wrapped; sentences of no usual length in pieces of ``CUT`` words."""
    out = []
    for block in re.split(r"\n[ \t]*(?:\n[ \t]*)+", text):
        lines = [x for x in block.split("\n") if x.strip()]
        if _wrapped(lines, common):
            lines = [" ".join(QUOTED.sub("", x).strip() for x in lines)]
        for line in lines:
            for part in SENTENCE.split(line) if len(line) > LONG else [line]:
                if len(part) <= 2 * LONG:
                    out.append(part)
                else:
                    w = part.split(" ")
                    out += [" ".join(w[i : i + CUT]) for i in range(0, len(w), CUT)]
    return out


def symbols(parts: list[str], common: frozenset[str]) -> tuple[list[int], list[int]]:
    """The symbol that each unit of a page emits, and its number of words."""
    lowered = [WORD.findall(p.lower()) for p in parts]
    counts = Counter(w for ws in lowered for w in ws)
    total = sum(counts.values())
    often = {w for w, n in counts.items() if n >= 4 and n >= 0.025 * total and w not in common and not w.isdigit()}
    out = []
    for p, ws in zip(parts, lowered):
        n = len(ws)
        known = sum(w in common for w in ws) / n if n else 0
        telling = [w for w in ws if w not in common]
        stuffed = sum(w in often for w in telling) / len(telling) if telling else 0
        if ADDRESS.search(p):
            rest = WORD.findall(LINK.sub(" ", p).lower())
            prose = len(rest) >= 12 and sum(w in common for w in rest) >= 0.25 * len(rest)
            out.append(SENTENCE_ if prose else ADDRESSED)
        elif n == 0:
            out.append(OTHER)
        elif CODE.match(p) or 4 * len(TAGS.findall(p)) >= n:
            out.append(TAGGED)
        elif RECORD.search(p):
            out.append(ROW)
        elif stuffed >= 0.55 and known < 0.34 and n >= 2:
            out.append(REPEATED)
        elif 5 * (separators := len(SEPARATOR.findall(p))) >= n and known < 0.4 and stuffed >= 0.25:
            out.append(REPEATED)
        else:
            numbers = len(NUMBER.findall(p))
            if known < 0.2 and (numbers >= 2 and separators >= 1 or numbers >= 1 and separators >= 2):
                out.append(ROW)
            elif known < 0.15 and LABELLED.match(p) and 4 * separators >= n:
                out.append(TAGGED)
            elif known >= 0.2 and (n >= 8 or END.search(p)):
                out.append(SENTENCE_)
            elif END.search(p) and n >= 5:
                out.append(PLAIN)
            elif known < 0.15 and (n <= 8 or 6 * separators >= n):
                out.append(TITLE)
            else:
                out.append(PLAIN if n >= 8 else OTHER)
    return out, [len(ws) for ws in lowered]


def viterbi(sequences: list[list[int]], model: Model | None = None) -> list[np.ndarray]:
    """Most likely states of each sequence of symbols; all sequences advance together."""
    model = model or untrained()
    k, log_emit, log_first, log_move = len(STATES), np.log(model.emit), np.log(model.first), np.log(model.move)
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sizes = np.array([len(sequences[i]) for i in order])
    longest = int(sizes[0]) if len(sizes) else 0
    score = log_first + np.stack([log_emit[:, sequences[i][0]] for i in order]) if longest else np.zeros((0, k))
    back = []
    for t in range(1, longest):
        alive = int(np.searchsorted(-sizes, -t, "left"))  # sequences longer than t
        emitted = np.array([sequences[i][t] for i in order[:alive]])
        through = score[:alive, :, None] + log_move
        back.append(through.argmax(1).astype(np.int8))
        score[:alive] = through.max(1) + log_emit[:, emitted].T
    out: list = [None] * len(sequences)
    state = score.argmax(1) if longest else np.zeros(0, int)
    states = np.zeros((len(sequences), longest), np.int8)
    for t in range(longest - 1, -1, -1):
        alive = int(np.searchsorted(-sizes, -t, "left"))
        states[:alive, t] = state[:alive]
        if t:
            state[:alive] = back[t - 1][np.arange(alive), state[:alive]]
    for i, n, path in zip(order, sizes, states):
        out[i] = path[:n]
    return out


def _read(words: list[str]):
    """Symbols of each page, a byte a unit, and the units' numbers of words."""
    schema = pa.schema([("doc_id", pa.int64()), ("symbols", pa.binary()), ("sizes", pa.list_(pa.int32()))])
    common = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 500):
                batch = big.slice(start, 500)
                seen = [symbols(units(t, common), common) for t in batch.column(1).to_pylist()]
                columns = batch.column(0), [bytes(s) for s, _ in seen], [sizes for _, sizes in seen]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    return run


def _run(model: Model, threshold: float, least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64())] + [(f"{s}_share", pa.float64()) for s in STATES] + [("spam", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 500):
                batch = big.slice(start, 500)
                rows = []
                for doc, sizes, path in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), viterbi(batch.column(1).to_pylist(), model)):
                    n = sum(sizes)
                    share = np.bincount(path, sizes, len(STATES)) / max(n, 1)
                    rows.append((doc, n, *share.tolist(), bool(n >= least and share[1:4].sum() > threshold)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def page_kinds(documents: DataFrame, common_words: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, least: int = 20, most: int = 20_000) -> DataFrame:
    """``doc_id``, ``n_words``, the share of its words in each state, and ``spam``.

    The model is trained without labels on all pages, and applied to all. What training and scoring need of them, a symbol and a
    number of words for each unit, is written once to the shared folder.
    Pages of fewer than ``least`` words are never spam; NULL and blank texts and NULL ids give no row; repeated ids give a row
    each. ``common_words`` is a fixed vocabulary; above ``most`` words this raises.
    """
    words = [r[0] for r in common_words.select(F.lower("word")).where("word is not null").distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"more than {most} common words")
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"(?U)\S"))
    pages = materialize(spread(texts).mapInArrow(_read(sorted(words)), "doc_id long, symbols binary, sizes array<int>"), "pages")
    model = train_on(pages)
    shares = ", ".join(f"{s}_share double" for s in STATES)
    return pages.mapInArrow(_run(model, threshold, least), f"doc_id long, n_words long, {shares}, spam boolean")
