"""Text quality statistics per document, and the rules that tell prose from lists, tables and junk.

All statistics of a batch of texts are computed on one array of code points: character classes by table lookup, counts
per line, block and text by segmented sums, common words by the hash of each word's lower-case characters. The rules
compare them with the published thresholds of Gopher (Rae et al. 2021) and FineWeb (Penedo et al. 2024), and those that a text
fails are recorded by name. A text that fails none, its length aside, is prose. For one that fails, the blocks, the stretches between
blank lines, say what it is instead, if they agree: which of them outweigh its prose is recorded with the rules, and the kind is read
off the record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.current import current_rows

SECTION = re.compile(r"\s*(_Section:.*_|#{1,6} .*)?\s*")
BULLET = re.compile(r"\s*([-*•–—·◦▪‣»>+]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s")
#: Characters that end a sentence, also before closing quotes and brackets.
END = re.compile(r"[.!?…:。！？][\"'”’»)\]]*\s*$")
SEPARATORS = ("\t", "|", ";", ",")
ALNUM, DIGIT, UPPER, SPACE, FOREIGN = 1, 2, 4, 8, 16
_tables: dict = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower-case form of each code point below 0x20000; those above count as the last of these."""
    if not _tables:
        kind, low = np.zeros(0x20000, np.uint8), np.arange(0x20000, dtype=np.uint64)
        for i in range(0x20000):
            c = chr(i)
            kind[i] = ALNUM * c.isalnum() | DIGIT * c.isdigit() | UPPER * c.isupper() | SPACE * c.isspace()
            if c.isupper() and len(c.lower()) == 1:
                low[i] = ord(c.lower())
        kind[0x80:0xA0] |= FOREIGN
        kind[0xFFFD] |= FOREIGN
        _tables["t"] = kind, low
    return _tables["t"]


POWERS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        p = np.array([ord(c) for c in w], np.uint64)
        with np.errstate(over="ignore"):
            out.append((p * POWERS[np.arange(len(p)) % 64]).sum(dtype=np.uint64))
    return np.unique(np.array(out, np.uint64))


def body_lines(text: str) -> list[str]:
    """Lines of the text without the section line and headings it begins with."""
    lines = text.split("\n")
    k = 0
    while k < len(lines) and SECTION.fullmatch(lines[k]):
        k += 1
    return lines[k:]


LINE_COUNTS = ("chars", "alnum", "digits", "upper", "foreign", "words", "common", "letters", "tokens", "single", "pairs", "long", "numbers", "alphabetic", "hashes", "width", "symbols")


def line_counts(lines: list[str], common: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts per line, and the numbers of separators of each kind in it (a column each for " / " and wide gaps at the end)."""
    kind, low = _classes()
    cp = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.minimum(cp, 0x1FFFF)
    k = kind[cp]
    ends = np.flatnonzero(cp == 10)
    starts = np.r_[0, ends[:-1] + 1]
    line = np.repeat(np.arange(len(lines)), ends - starts + 1)
    alnum, space = (k & ALNUM) > 0, (k & SPACE) > 0
    per = lambda mask: np.bincount(line[mask], minlength=len(lines))
    before = lambda mask, first: np.r_[first, mask[:-1]]
    word_start = alnum & ~before(alnum, False)
    at = np.flatnonzero(word_start)
    chars = np.flatnonzero(alnum)
    which = np.cumsum(word_start)[chars] - 1
    common_word = np.zeros(len(at), bool)
    if len(at):
        with np.errstate(over="ignore"):
            h = np.add.reduceat(low[cp[chars]] * POWERS[(chars - at[which]) % 64], np.searchsorted(which, np.arange(len(at))))
        if len(common):
            common_word = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
    token = np.flatnonzero(~space & before(space, True))
    stop = np.flatnonzero(space & ~before(space, True))
    size = stop - token
    out = {
        "chars": per(~space),
        "alnum": per(alnum),
        "digits": per((k & DIGIT) > 0),
        "upper": per((k & UPPER) > 0),
        "foreign": per((k & FOREIGN) > 0),
        "words": np.bincount(line[at], minlength=len(lines)),
        "common": np.bincount(line[at[common_word]], minlength=len(lines)),
        "letters": per(alnum & ((k & DIGIT) == 0)),
    }
    for name, mask in (("tokens", size > 0), ("single", (size == 1) & alnum[token]), ("pairs", size == 2), ("long", size > 24), ("numbers", (k[token] & DIGIT) > 0)):
        out[name] = np.bincount(line[token[mask]], minlength=len(lines))
    letters = np.r_[0, np.cumsum(alnum & ((k & DIGIT) == 0))]
    out["alphabetic"] = np.bincount(line[token[letters[stop] > letters[token]]], minlength=len(lines))
    out["hashes"] = per(cp == ord("#"))
    out["width"] = ends - starts
    out["symbols"] = out["chars"] - out["alnum"]
    seps = [per(cp == ord(c)) for c in SEPARATORS]
    slash = cp == ord("/")
    strokes = per(slash & before(space, False) & np.r_[space[1:], True])
    colons = per((cp == ord(":")) & np.r_[space[1:], True])
    seps.append(np.where(strokes > 0, strokes + colons, 0))
    gap = (cp == 32) & before(cp == 32, False) & ~before(before(cp == 32, False), False)
    inside = np.zeros(len(cp), bool)
    first = np.full(len(lines), len(cp))
    np.minimum.at(first, line[token], token)
    inside[gap] = np.flatnonzero(gap) > first[line[gap]]
    seps.append(per(inside))
    return out, np.stack(seps, 1)


def block_kinds(c: dict[str, np.ndarray], lines: np.ndarray, bullets: np.ndarray, cells: np.ndarray, numeric: np.ndarray, plain: np.ndarray, ends: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Kind of each block: 0 prose, 1 list, 2 table, 3 junk, 4 a short line by itself.

    ``cells``: the share of its lines that agree on some number of separators; ``numeric``: of lines with two or more numbers;
    ``plain``: of its characters that are letters; ``around``: the share of common words in the whole text.
    """
    words, tokens, chars = np.maximum(c["words"], 1), np.maximum(c["tokens"], 1), np.maximum(c["chars"], 1)
    known = c["common"] / words
    junk = (
        (c["foreign"] / words > 0.1)
        | ((c["single"] / tokens > 0.5) & (tokens >= 20))
        | ((c["pairs"] / tokens > 0.6) & (tokens >= 16) & (known < 0.1))
        | ((c["long"] / tokens > 0.5) & (known < 0.05) & (cells < 0.6))
        | ((c["symbols"] / chars > 0.12) & (known < 0.2) & (cells < 0.6) & (bullets / lines < 0.5) & (chars >= 40))
        | ((known < 0.05) & (words >= 30) & (c["digits"] == 0) & (c["upper"] / chars < 0.005) & (c["symbols"] / chars < 0.01) & (words / lines >= 10))
        | ((known < 0.02) & (words >= 30) & (plain > 0.9) & (words / lines >= 10) & (cells < 0.6) & (c["symbols"] / chars < 0.02))
    )
    table = ((cells >= 0.6) | (numeric >= 0.6)) & (lines >= 2) & (known < 0.2)
    short = words / lines <= 8
    items = (known < 0.22) & ((bullets / lines >= 0.5) | short & (lines >= 3) & (ends / lines < 0.5) & (around < 0.22))
    alone = short & (lines < 3) & (ends == 0)
    return np.select([junk, table, items, alone], [3, 2, 1, 4], 0)


def _most_agreeing(count: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Of each block the most lines that have the same number, at least two, of separators."""
    keep = count >= 2
    best = np.zeros(n)
    if keep.any():
        pair, times = np.unique(np.stack([block[keep], count[keep]]), axis=1, return_counts=True)
        np.maximum.at(best, pair[0], times)
    return best


#: Published rules, and then what the blocks of a text that fails one can be.
RULES = ("words", "word_length", "symbols", "bullets", "ellipses", "alphabetic", "common_words", "line_ends", "short_lines", "newlines", "list_blocks", "table_blocks", "junk_blocks")


def kind_of(reasons: list[str]) -> str | None:
    """What a text is by its recorded reasons."""
    blocks = [r.removesuffix("_blocks") for r in reasons if r.endswith("_blocks")]
    return blocks[0] if blocks else None


def assess(texts: list[str], common: np.ndarray) -> dict[str, list]:
    """Statistics, failed rules and kind (None: prose) of texts that are not blank."""
    split = [body_lines(t) for t in texts]
    split = [s if any(x.strip() for x in s) else t.split("\n") for s, t in zip(split, texts)]
    lines = [x for s in split for x in s]
    text = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    full = np.array([bool(x.strip()) for x in lines])
    c, seps = line_counts(lines, common)
    bullet = np.array([bool(BULLET.match(x)) for x in lines])
    end = np.array([bool(END.search(x)) for x in lines])
    dots = np.array([x.rstrip().endswith(("...", "…")) for x in lines])
    new = full & (~np.r_[False, full[:-1]] | np.r_[True, text[1:] != text[:-1]])
    block = np.cumsum(new) - 1
    use = np.flatnonzero(full)
    block, owner, n = block[use], text[use], int(new.sum())
    total = lambda x: np.bincount(block, x[use], minlength=n)
    sums = {k: total(v) for k, v in c.items()}
    size = np.maximum(np.bincount(block, minlength=n), 1)
    agree = np.max([_most_agreeing(seps[use, k], block, n) for k in range(seps.shape[1])], axis=0) / size
    # Cells are short: a sentence with commas is no row.
    agree[sums["words"] / np.maximum(1, total(seps.max(1) + 1)) > 5] = 0
    numeric = total((c["numbers"] >= 2) & (c["common"] * 5 <= c["words"]) & ~bullet) / size
    plain = sums["letters"] / np.maximum(1, sums["chars"])
    of = np.zeros(n, np.int64)
    of[block] = owner
    around = np.bincount(text, c["common"], len(texts)) / np.maximum(1, np.bincount(text, c["words"], len(texts)))
    kind = block_kinds(sums, size, total(bullet), agree, numeric, plain, total(end), around[of])
    weight = np.zeros((len(texts), 5))
    np.add.at(weight, (of, kind), sums["chars"])
    alone = np.bincount(of[kind == 4], minlength=len(texts))
    listed = (alone >= 3) | (weight[:, 1] > 0)
    weight[listed, 1] += weight[listed, 4]
    weight[~listed, 0] += weight[~listed, 4]
    odd = weight[:, 1:4]
    found = np.where(odd.sum(1) > weight[:, 0], 1 + odd.argmax(1), 0)  # what outweighs the prose
    per = lambda x: np.bincount(owner, x[use], minlength=len(texts))
    t = {k: per(v) for k, v in c.items()}
    n_lines, words, tokens = np.maximum(per(np.ones(len(lines))), 1), np.maximum(t["words"], 1), np.maximum(t["tokens"], 1)
    stats = {
        "n_words": t["words"],
        "n_lines": per(np.ones(len(lines))),
        "mean_word_length": t["alnum"] / words,
        "symbol_ratio": t["symbols"] / tokens,
        "digit_ratio": t["digits"] / np.maximum(t["chars"], 1),
        "line_end_share": per(end) / n_lines,
        "bullet_share": per(bullet) / n_lines,
        "ellipsis_share": per(dots) / n_lines,
        "common_word_share": t["common"] / words,
    }
    marks = t["hashes"] + per(np.array([x.count("...") + x.count("…") for x in lines], np.int64))
    # The published thresholds. Gopher: words, word length, hashes and ellipses to words, lines that begin with bullets or
    # end with an ellipsis, words with a letter, common words. FineWeb: lines that end a sentence, lines of at most 30 characters, newlines to words.
    failed = np.stack(
        [
            (t["words"] < 50) | (t["words"] > 100_000),
            (stats["mean_word_length"] < 3) | (stats["mean_word_length"] > 10),
            marks / tokens > 0.1,
            stats["bullet_share"] > 0.9,
            stats["ellipsis_share"] > 0.3,
            t["alphabetic"] / tokens < 0.8,
            t["common"] < 2,
            stats["line_end_share"] <= 0.12,
            per(c["width"] <= 30) / n_lines >= 0.67,
            (n_lines - 1) / tokens > 0.3,
        ],
        1,
    )
    doubtful = failed[:, 1:].any(1)  # short texts are prose as well as long ones
    failed = np.concatenate([failed, np.stack([doubtful & (found == k) for k in (1, 2, 3)], 1)], 1)
    reasons = [[RULES[i] for i in np.flatnonzero(row)] for row in failed]
    out = {k: v.tolist() for k, v in stats.items()}
    out["n_words"], out["n_lines"] = t["words"].astype(int).tolist(), stats["n_lines"].astype(int).tolist()
    return out | {"failed_rules": reasons, "kind": [kind_of(r) for r in reasons]}


SCHEMA = pa.schema(
    [("id", pa.string()), ("n_words", pa.int64()), ("n_lines", pa.int64())]
    + [(n, pa.float64()) for n in ("mean_word_length", "symbol_ratio", "digit_ratio", "line_end_share", "bullet_share", "ellipsis_share", "common_word_share")]
    + [("failed_rules", pa.list_(pa.string())), ("kind", pa.string())]
)
COLUMNS = (
    "id string, n_words long, n_lines long, mean_word_length double, symbol_ratio double, digit_ratio double, line_end_share double, "
    "bullet_share double, ellipsis_share double, common_word_share double, failed_rules array<string>, kind string"
)


def _run(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = hashes(words)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start, size = 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size > 1_000_000 or k + 1 == len(texts):
                    part = batch.slice(start, k + 1 - start)
                    full = np.flatnonzero(np.asarray(part.column(1).is_valid()))
                    out = assess([texts[start + i] for i in full], common) if len(full) else {f.name: [] for f in SCHEMA}
                    place = np.full(part.num_rows, -1)
                    place[full] = np.arange(len(full))
                    at = pa.array(place, mask=place < 0)
                    columns = [pa.array(out[f.name], f.type).take(at) for f in SCHEMA if f.name != "id"]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns, part.column(2)], [*SCHEMA.names, "version"])
                    start, size = k + 1, 0

    return run


def text_quality(df: DataFrame, id_col: str, text_col: str, common_words: DataFrame, word_col: str = "word", most: int = 20_000, version_col: str | None = None) -> DataFrame:
    """A row of statistics per row with a text: see ``COLUMNS``; ``kind`` is ``list``, ``table``, ``junk`` or, for prose, NULL.

    ``failed_rules``: the published rules that the text fails, and which blocks outweigh its prose if it fails one besides its length.
    The section line and headings a text begins with are left out. NULL and blank texts give no row; repeated ids give a row
    each. With ``version_col`` only the row of each id with the greatest version counts, also if it has no text; statistics are taken
    before rows are compared, so that these travel and not the texts. ``common_words`` is a fixed vocabulary; above ``most`` words this
    raises instead of sending it round.
    """
    words = [r[0] for r in common_words.select(F.lower(word_col)).where(F.col(word_col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"more than {most} common words")
    text, version = F.col(text_col), F.lit(0) if version_col is None else F.col(version_col)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.when(text.rlike(r"(?U)\S"), text).alias("text"), version.alias("version"))
    if version_col is None:
        rows = rows.where(F.col("text").isNotNull())
    found = rows.mapInArrow(_run(sorted(words)), f"{COLUMNS}, version {rows.schema['version'].dataType.simpleString()}")
    if version_col is None:
        return found.drop("version")
    return current_rows(found, "id", "version", {c: F.col(c) for c in SCHEMA.names if c != "id"}).where(F.col("n_words").isNotNull())
