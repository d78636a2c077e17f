"""Language-model scores by a class bigram model over Brown classes.

Words are counted over all training texts. The most frequent words, and one symbol per
word ending for all others, are put into classes by exchange: a symbol at a time moves to
the class that raises the mutual information of adjacent classes most, until no symbol
moves. From there every other word of the table moves on its own, by its own counts with
the classes beside it: all at once per sweep, in Spark, for as long as the information of
all adjacent words' classes rises (a half or a quarter of them where all at once lower it). A token then has the smoothed probability of its class
after the last one's, times the smoothed probability of the word in its class.

Sizes on the driver are fixed by parameters: the bigram table of ``CLUSTERED`` words and
``ENDINGS`` symbols, the class-by-class sums, and the counts and classes of the ``LISTED``
most frequent words, which scoring tasks look up. Counts and classes of all other words are
joined. Words that no training text has are in the class of their ending.

Tokens are the words after lower-casing A-Z, then one end. Defined cases: a NULL or empty
text is one end. A NULL doc_id counts as an empty one when texts are held out. Repeated
rows are learnt and scored each. Ties in frequency go by word. Without training texts all
counts are 0. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilect.llm.shared import crc_remainder, drop, release, slices, text_of
from trilect.operators.ordering import lookup_join
from trilect.session import configure, store

CLUSTERED, ENDINGS, CLASSES, LISTED = 2048, 512, 64, 1 << 17
#: Weight, in tokens, of the class frequencies in a class's successors.
BACKOFF = 20.0
SWEEPS = 12
#: Sweeps over the whole word table, at most; None: until nothing moves.
TABLE_SWEEPS = 2
SLICE_BYTES = 8 << 20
#: The end of a text in word tables; no word is empty.
END = ""


def tokenize(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, all words as numbers of these, and where each text's words end."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words: list[bytes] = []
    ends = np.empty(len(texts), np.int64)
    for k, t in enumerate(texts):
        words += t.encode().lower().split()  # bytes: ASCII letters and blanks only
        ends[k] = len(words)
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return list(number), codes, ends


def ending(word: bytes, endings: int) -> int:
    """The symbol of a word without one of its own: a hash of its last three characters."""
    return zlib.crc32(word.decode()[-3:].encode()) % endings


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in slices(batches, column, SLICE_BYTES):
        yield batch, batch.column(column).to_pylist()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) of a ``text`` column, the end of texts included; summed per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _texts(batches, 0):
            words, codes, ends = tokenize(rows)
            counts = np.append(np.bincount(codes, minlength=len(words)), len(ends))
            yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in words] + [END], "n": pa.array(counts, pa.int64())})

    return texts.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def symbols_of(words: list[bytes], clustered: dict[bytes, int], endings: int) -> np.ndarray:
    """Clustered words come first, then the endings; the end of texts is the last symbol."""
    m = len(clustered)
    return np.array([clustered[w] if w in clustered else m + ending(w, endings) for w in words], np.int64)


def count_bigrams(texts: DataFrame, clustered: list[str], endings: int) -> DataFrame:
    """(pair, n): adjacent symbols, left * symbols + right; at most symbols ** 2 rows."""
    total = len(clustered) + endings + 1
    shared = texts.sparkSession.sparkContext.broadcast({w.encode(): k for k, w in enumerate(clustered)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for _, rows in _texts(batches, 0):
            words, codes, ends = tokenize(rows)
            line = np.insert(symbols_of(words, known, endings)[codes] if words else codes, ends, total - 1)
            line = np.append(total - 1, line)
            pairs, n = np.unique(line[:-1] * total + line[1:], return_counts=True)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs, pa.int64()), "n": pa.array(n, pa.int64())})

    return texts.select("text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, total: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each symbol; the last symbol (the end) has the last class to itself.

    Symbols start by frequency, in turn, and are visited in that order. A symbol is taken
    out of its class and put where the sum of n log n over class pairs, less that over
    class totals, is largest; it stays on ties.
    """
    n = n.astype(np.float64)
    frequency = np.bincount(right, n, total)
    order = np.argsort(-frequency[:-1], kind="stable")
    of = np.zeros(total, np.int64)
    of[order] = np.arange(total - 1) % classes
    of[-1] = classes
    width = classes + 1
    matrix = np.bincount(of[left] * width + of[right], n, width * width).reshape(width, width)

    def by(keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.argsort(keys, kind="stable")
        return np.searchsorted(keys[place], np.arange(total + 1)), others[place], n[place]

    rows, columns = by(left, right), by(right, left)
    g = lambda x: x * np.log(np.maximum(x, 1.0))

    def beside(w: int, side: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, float]:
        begins, others, counts = side
        a, b = begins[w], begins[w + 1]
        other, count = others[a:b], counts[a:b]
        self = other == w
        return np.bincount(of[other[~self]], count[~self], width), float(count[self].sum())

    for _ in range(sweeps):
        moved = 0
        for w in order:
            after, itself = beside(w, rows)
            before, _ = beside(w, columns)
            if not (after.any() or before.any() or itself):
                continue
            home = of[w]
            matrix[home] -= after
            matrix[:, home] -= before
            matrix[home, home] -= itself
            inner = matrix.diagonal()
            gain = (g(matrix + after) - g(matrix)).sum(1) + (g(matrix.T + before) - g(matrix.T)).sum(1)
            gain += g(inner + after + before + itself) + g(inner) - g(inner + after) - g(inner + before)
            # Whatever class takes the symbol, the others keep their pairs with it in their totals.
            for sums, own in ((matrix.sum(1) + before, after.sum() + itself), (matrix.sum(0) + after, before.sum() + itself)):
                gain -= g(sums + own) - g(sums)
            gain[-1] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[home] + 1e-9:
                best = int(home)
            moved += best != home
            of[w] = best
            matrix[best] += after
            matrix[:, best] += before
            matrix[best, best] += itself
        if not moved:
            break
    return of


def hashed(words: list[bytes]) -> np.ndarray:
    """Spark's xxhash64 of each word; spellings stay in the word table alone."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).astype(np.int64)


def count_neighbours(texts: DataFrame, core: dict[bytes, int], width: int, first: np.ndarray | None = None) -> DataFrame:
    """(a, b, key, n) of adjacent words; ``core`` has the classes of the words that never move.

    A word beside a core word is counted in the map task with the core word's class: a is its
    hash, key the class, or ``width`` + class where the core word stands before it. Of two core
    words only key remains, left class * ``width`` + right class. Two others are counted as the
    hashes a and b. The end of texts is a core word of the last class.

    ``first`` has the classes by ending that all other words start in (0 without it). They are
    part of the keys: 2 * ``width`` * class is added to the key of a word beside a core word, and
    two others have the key left class * ``width`` + right class.
    """
    starts = np.zeros(1, np.int64) if first is None else first
    shared = texts.sparkSession.sparkContext.broadcast((core, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, starts = shared.value

        def rows(keys: list[np.ndarray], size: int) -> list[pa.Array]:
            """The distinct combinations of keys below ``size`` with their numbers."""
            first, second = keys
            both, n = np.unique(first * size + second, return_counts=True)
            return [*np.divmod(both, size), n]

        for _, batch in _texts(batches, 0):
            words, codes, ends = tokenize(batch)
            words.append(END.encode())
            end = len(words) - 1
            k = np.array([known.get(w, -1) for w in words], np.int64)
            k[end] = width - 1
            begin = np.array([0 if c >= 0 else starts[ending(w, len(starts))] for w, c in zip(words, k)], np.int64)
            of_word = hashed(words)
            line = np.append(end, np.insert(codes, ends, end))
            a, b = line[:-1], line[1:]
            ka, kb = k[a], k[b]
            fixed_a, fixed_b = ka >= 0, kb >= 0
            out = []
            both = fixed_a & fixed_b
            x, y, n = rows([ka[both], kb[both]], width)
            out.append((None, None, x * width + y, n))
            word = np.concatenate([a[~fixed_a & fixed_b], b[fixed_a & ~fixed_b]])
            key = np.concatenate([kb[~fixed_a & fixed_b], ka[fixed_a & ~fixed_b] + width])
            x, y, n = rows([word, key], 2 * width)
            out.append((of_word[x], None, begin[x] * 2 * width + y, n))
            free = ~fixed_a & ~fixed_b
            x, y, n = rows([a[free], b[free]], len(words))
            out.append((of_word[x], of_word[y], begin[x] * width + begin[y], n))
            for x, y, key, n in out:
                size = len(n)
                whole = [pa.nulls(size, t) if v is None else pa.array(v, t) for v, t in ((x, pa.int64()), (y, pa.int64()), (key, pa.int32()), (n, pa.int64()))]
                yield pa.RecordBatch.from_arrays(whole, names=["a", "b", "key", "n"])

    found = texts.select("text").mapInArrow(run, "a bigint, b bigint, key int, n bigint")
    return found.groupBy("a", "b", "key").agg(F.sum("n").alias("n"))


def contexts(neighbours: DataFrame, classes_of: DataFrame | None, width: int) -> DataFrame:
    """(word, key, k, n, core): how often each word stands before a class (key below ``width``) and after one.

    ``core`` is the part of n that comes from core words. Only pairs of two other words meet classes by joins,
    and none do without ``classes_of``: the classes that words start in are in the keys.
    """

    def part(divisor: int) -> tuple[Column, Column]:
        return F.floor(F.col("key") / divisor).cast("int"), F.col("key") % divisor

    pairs = neighbours.filter("b IS NOT NULL")
    first, key = part(2 * width)
    fixed = neighbours.filter("b IS NULL AND a IS NOT NULL").select(F.col("a").alias("word"), key.alias("key"), first.alias("k"), "n", F.col("n").alias("core"))
    if classes_of is None:
        ka, kb = part(width)
        both = pairs.select("a", "b", "n", ka.alias("ka"), kb.alias("kb"))
    else:
        known = classes_of.select("word", "k")
        left = lookup_join(pairs.select("a", "b", "n"), known.withColumnsRenamed({"word": "a", "k": "ka"}), ["a"])
        both = lookup_join(left, known.withColumnsRenamed({"word": "b", "k": "kb"}), ["b"])
        fixed = lookup_join(fixed.drop("k"), known, ["word"])
    before = F.struct(F.col("a").alias("word"), F.col("kb").alias("key"), F.col("ka").alias("k"))
    after = F.struct(F.col("b").alias("word"), (F.col("ka") + width).alias("key"), F.col("kb").alias("k"))
    none = F.lit(0).cast("bigint").alias("core")
    sides = both.select(F.explode(F.array(before, after)).alias("x"), "n").select("x.word", "x.key", "x.k", "n", none)
    return fixed.unionByName(sides).groupBy("word", "key", "k").agg(F.sum("n").alias("n"), F.sum("core").alias("core"))


def class_pairs(neighbours: DataFrame, met: DataFrame, width: int) -> np.ndarray:
    """The class-by-class counts: of two core words, of a word before anything, and of a core word before it."""
    follows = np.zeros(width * width)
    core = neighbours.filter("a IS NULL").select("key", "n")
    before = met.filter(F.col("key") < width).select((F.col("k") * width + F.col("key")).alias("key"), "n")
    after = met.filter(F.col("key") >= width).select(((F.col("key") - width) * width + F.col("k")).alias("key"), F.col("core").alias("n"))
    for r in core.unionByName(before).unionByName(after).groupBy("key").agg(F.sum("n").alias("n")).collect():
        follows[r["key"]] = r["n"]
    return follows.reshape(width, width)


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def information(follows: np.ndarray) -> float:
    """What ``exchange`` raises: the sum of n log n over class pairs, less that over class totals."""
    return float(_g(follows).sum() - _g(follows.sum(1)).sum() - _g(follows.sum(0)).sum())


def best_classes(home: np.ndarray, begins: np.ndarray, key: np.ndarray, n: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of words with contexts ``begins[i]`` to ``begins[i + 1]`` the class that raises the information most.

    A word's own counts are taken out of its class first; its neighbours' classes stay. It
    stays on ties, and never joins the class of the end.
    """
    width = len(follows)
    sides = np.concatenate([follows.T, follows])  # by key: the counts with each class in the word's place
    owner = np.repeat(np.arange(len(home)), np.diff(begins))
    base = sides[key]
    gain = _g(base + n[:, None]) - _g(base)
    own = np.arange(len(key)), home[owner]
    gain[own] = _g(base[own]) - _g(np.maximum(base[own] - n, 0.0))
    gain = np.add.reduceat(gain, begins[:-1], axis=0)
    for side, totals in ((key < width, follows.sum(1)), (key >= width, follows.sum(0))):
        count = np.bincount(owner, n * side, len(home))[:, None]
        less = _g(totals + count) - _g(totals)
        at = np.arange(len(home)), home
        less[at] = _g(totals[home]) - _g(np.maximum(totals[home] - count[:, 0], 0.0))
        gain -= less
    gain[:, -1] = -np.inf
    best = gain.argmax(1)
    rows = np.arange(len(home))
    return np.where(gain[rows, best] > gain[rows, home] + 1e-9, best, home)


def moved(met: DataFrame, follows: np.ndarray) -> DataFrame:
    """(word, k, home): each word's best class, and the one that it has."""
    shared = met.sparkSession.sparkContext.broadcast(follows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = batch.column(2)
                begins = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
                keys, n = (x.to_numpy() for x in lists.flatten().flatten())
                home = batch.column(1).to_numpy()
                best = best_classes(home, begins, keys, n.astype(np.float64), matrix)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), batch.column(1)], names=["word", "k", "home"])

    each = met.groupBy("word").agg(F.min("k").alias("k"), F.collect_list(F.struct("key", "n")).alias("beside"))
    return each.mapInArrow(run, "word bigint, k int, home int")


def frequent_words(words: DataFrame, most: int) -> pa.Table:
    """The rows of the end and of the most frequent words, ``most`` at most.

    Words are counted by 64 steps to a doubling of their count, and whole steps are taken
    from the top; no more than the words taken and a few thousand sums reach the driver.
    """
    step = F.floor(F.log2("c") * 64).cast("int")
    sizes = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, least = most, 1 << 30
    for r in sorted(sizes, reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    return words.filter((step >= least) | (F.col("word") == END)).toArrow()


def train(texts: DataFrame, clustered: int = CLUSTERED, endings: int = ENDINGS, classes: int = CLASSES, listed: int = LISTED, sweeps: int | None = TABLE_SWEEPS) -> dict:
    """Learns from a ``text`` column. ``words`` is the stored table of all words' counts and classes; the rest has a fixed size.

    ``sweeps`` limits the sweeps over the whole word table; with None they go on until nothing moves.
    """
    counted = store(count_words(texts))
    tokens, types = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    taken = frequent_words(counted, listed)
    counts = {w.encode(): c for w, c in zip(taken["word"].to_pylist(), taken["c"].to_pylist())}
    ranked = sorted((w for w in counts if w != END.encode()), key=lambda w: (-counts[w], w))
    chosen = [w.decode() for w in ranked[:clustered]]
    total = len(chosen) + endings + 1
    release(texts.sparkSession)
    pairs = count_bigrams(texts, chosen, endings).toArrow()
    left, right = (x.astype(np.int32) for x in np.divmod(pairs["pair"].to_numpy(), total))
    n = pairs["n"].to_numpy()
    del pairs
    of = exchange(left, right, n, total, classes)
    del left, right, n
    width = classes + 1
    core = {w.encode(): k for k, w in enumerate(chosen)}
    shared = texts.sparkSession.sparkContext.broadcast((core, of))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes_of = shared.value
        for batch in batches:
            spelled = [w.encode() for w in batch.column(0).to_pylist()]
            k = np.where([w == END.encode() for w in spelled], classes_of[-1], classes_of[symbols_of(spelled, known, endings)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k, pa.int32())], names=["word", "k"])

    placed = store(counted.mapInArrow(start, "word string, k int"))
    beside = store(count_neighbours(texts, {w: int(of[k]) for w, k in core.items()}, width, of[len(chosen) : -1]))
    release(texts.sparkSession)
    own = F.xxhash64("word")
    free = placed.filter(F.col("word") != END).select(own.alias("word"), "k")
    met = store(contexts(beside, None, width))
    follows = class_pairs(beside, met, width)
    release(texts.sparkSession)
    done = 0
    while sweeps is None or done < sweeps:
        done += 1
        better = store(moved(met, follows))
        drop(met)  # every word's contexts are counted anew below
        release(texts.sparkSession)
        if better.filter("k <> home").isEmpty():
            break
        # All words at once; if they spoil each other's moves, one half of them, then one quarter.
        for part in (1, 2, 4):
            stays = F.pmod("word", F.lit(part)) != 0
            other = better.select("word", F.when(stays, F.col("home")).otherwise(F.col("k")).alias("k"))
            tried = store(contexts(beside, other, width))
            now = class_pairs(beside, tried, width)
            release(texts.sparkSession)
            if information(now) > information(follows):
                break
            drop(tried)
        else:
            break
        free, met, follows = other, tried, now
    for done_with in (beside, met):
        drop(done_with)
    release(texts.sparkSession)
    share = (follows.sum(0) + 0.5) / (follows.sum() + 0.5 * width)
    steps = np.log10((follows + BACKOFF * share) / (follows.sum(1, keepdims=True) + BACKOFF))
    # Core words have no row of their own in ``free`` once a sweep was made.
    last = free.select(F.col("word").alias("own"), F.col("k").alias("now"))
    classed = lookup_join(placed.withColumn("own", own), last, ["own"], "left").select("word", F.coalesce("now", "k").alias("k"))
    words = store(counted.join(classed, "word"))
    taken = frequent_words(words, listed)
    own = {w.encode(): k for w, k in zip(taken["word"].to_pylist(), taken["k"].to_pylist()) if w != END}
    # Tokens and types of each class, for the words' share in it; counted over the whole table.
    held, kinds = np.zeros(width), np.zeros(width)
    for r in words.filter(F.col("word") != END).groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("types")).collect():
        held[r["k"]], kinds[r["k"]] = r["c"], r["types"]
    return {
        "words": words, "tokens": int(tokens), "types": int(types), "counts": counts,
        "clustered": {w: k for k, w in enumerate(own)}, "endings": endings,
        "of": np.append(np.array(list(own.values()), np.int64), of[len(chosen) :]), "steps": steps, "within": np.log10(held + 0.5 * (kinds + 1)),
    }


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of each row.

    The words of a text that aren't listed meet their counts and classes by a join, once
    for equal texts, and come back to the text in one list.
    """
    keep = ("counts", "clustered", "endings", "of", "steps", "within")
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in keep})
    source = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    source = source.select("doc_id", F.xxhash64("text").alias("of_text"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    floor = float(np.log10(model["tokens"] + 0.5 * (model["types"] + 1)))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value["counts"]
        for batch, rows in _texts(batches, 1):
            words, codes, ends = tokenize(rows)
            owner = np.repeat(np.arange(len(rows)), np.diff(np.append(0, ends)))
            seek = np.array([w not in listed for w in words], bool)[codes] if words else np.zeros(0, bool)
            found = np.unique(owner[seek] * max(1, len(words)) + codes[seek])
            of_row, of_word = np.divmod(found, max(1, len(words)))
            spelled = pa.array([w.decode() for w in words], pa.string()).take(pa.array(of_word))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of_row)), spelled], names=["of_text", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        of, steps, within = m["of"], m["steps"], m["within"]
        end_class = int(of[-1])
        end_count = m["counts"].get(END.encode(), 0)
        for batch, rows in _texts(batches, 1):
            words, codes, ends = tokenize(rows)
            fields = batch.column(2).flatten().flatten()
            met = {w.encode(): x for w, *x in zip(*(f.to_pylist() for f in fields))}
            c = np.array([m["counts"].get(w) or met.get(w, (0,))[0] for w in words], np.int64)
            k = of[symbols_of(words, m["clustered"], m["endings"])] if words else np.zeros(0, np.int64)
            for j, w in enumerate(words):
                if w in met:
                    k[j] = met[w][1]
            begins = np.append(0, ends[:-1])
            logs = np.log10(c + 0.5)
            sums = lambda x: np.add.reduceat(np.append(x[codes], 0), begins) * (ends > begins) if len(begins) else x  # noqa: E731, B023
            counted = (sums(logs) if len(rows) else np.zeros(0)) + np.log10(end_count + 0.5)
            line = np.append(end_class, np.insert(k[codes], ends, end_class))
            step = np.append(0.0, np.cumsum(steps[line[:-1], line[1:]]))
            places = np.arange(len(rows))
            path = step[ends + places + 1] - step[begins + places]
            inside = sums(within[k]) if len(rows) else np.zeros(0)
            n_tokens = ends - begins + 1
            n_known = sums((c > 0).astype(np.int64)).astype(np.int64) + int(end_count > 0)
            scores = path + counted - np.log10(end_count + 0.5) - inside
            out = [batch.column(0), pa.array(n_tokens), pa.array(n_known), pa.array(counted - n_tokens * floor), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    sought = source.select("of_text", "text").mapInArrow(rare, "of_text bigint, word string").distinct()
    answers = sought.join(model["words"], "word").groupBy("of_text").agg(F.collect_list(F.struct("word", "c", "k")).alias("met"))
    full = source.join(answers, "of_text", "left").select("doc_id", "text", "met")
    scored = full.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_held_out(docs: DataFrame, modulus: int = 5, held: int = 1) -> DataFrame:
    """Learns from the texts whose crc32 remainder isn't ``held`` and scores all."""
    configure(docs.sparkSession)
    texts = docs.filter(crc_remainder("doc_id", modulus) != held).select(text_of("text").alias("text"))
    model = train(texts)
    return score(docs, model).withColumns({"held_out": crc_remainder("doc_id", modulus) == held, "train_tokens": F.lit(model["tokens"]).cast("bigint")})
