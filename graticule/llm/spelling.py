"""Spelling variants: for each word of a corpus, the much commoner word one edit away, and where a chain of these ends.

Counting takes the maximal runs of letters of every text in the JVM; runs too short to become words are never made, and equal
words are summed in the task before they are exchanged.

Near words differ by exactly one inserted, deleted or replaced code point. The edit leaves one half of a word as it is: a
word's first half begins each near word whose edit lies behind it, its second half ends every other. Words are dealt by the
half that has to be equal, forwards and (spelled backwards) for the other half; as a near word may be longer or shorter by
one, a word goes to the halves of up to two lengths. Each task builds a minimal acyclic automaton of its words in each
direction, in which the path of a word adds up to its number in their order (a minimal perfect hash). All its asking words
follow their exact half from the root together, go on with one error in every way, and read the rest exactly; what ends in
a final state is a near word, by its number. Edits are taken at the last of the places that give the same word, and the
backward search leaves out words that share the first half, so no pair is found twice. A task returns one row for each
asking word: how many near words it found, and the best of them. Both directions are added up by word.

A half that more than `HOT` words share is split: its words go to several tasks by their hash, and the words that ask in it
ask each of these.

Edge cases: null and empty texts have no words; a null doc_id counts as the empty text in `<doc_id>:<run>`; repeated rows count
each; a word of any length is handled, in time and memory that follow its length; ties for the form go to the smallest word
in code-point order. An empty table gives an empty result. Extra columns are ignored, whatever their names. A chain of forms
ends, since n grows at least tenfold at each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import cut, maybe_broadcast

#: Letters of a run: ASCII and U+00C0 to U+00FF, each one byte in Latin-1.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many (by checksum) runs of a document loses a code point.
DAMAGED = 31
#: Words (with their repetitions for other lengths) in a task, about, and words of one half that are kept together.
IN_TASK, HOT = 150_000, 30_000
#: Words that search at once.
AT_ONCE = 20_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n (occurrences) of every word that occurs often enough."""
    pattern = f"[{LETTERS}]{{{LEAST_LENGTH},}}+"
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(pattern), F.lit(0))).alias("_run"))
    mark = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    runs = runs.select("_run", mark.alias("_h"), F.length("_run").alias("_n"))
    at = (F.col("_h") % F.col("_n")).cast("int")
    shorter = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.col("_n")))
    words = runs.select(F.when(F.col("_h") % DAMAGED == 0, shorter).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """A minimal acyclic automaton of distinct words in order; the skips along a word's path add up to its place in them.

    States are numbered from those that no other state is reached from on, so edges lead to lower numbers. Edges lie
    in arrays by state and label: `keys` is state * 256 + label.
    """

    def __init__(self, words: list[bytes]):
        known: dict[tuple, int] = {}
        path: list[list] = [[False]]  # of the last word: whether a word ends there, then labels and states of finished edges
        last = b""
        for word in words:
            shared = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                shared += 1
            self._finish(path, last, shared, known)
            path.extend([False] for _ in range(len(word) - shared))
            path[-1][0] = True
            last = word
        self._finish(path, last, 0, known)
        self.root = known.setdefault(tuple(path[0]), len(known))

        states = list(known)
        self.final = np.fromiter((s[0] for s in states), bool, len(states))
        many = np.fromiter((len(s) // 2 for s in states), np.int64, len(states))
        self.first = np.r_[0, np.cumsum(many)]
        flat = np.fromiter((x for s in states for x in s[1:]), np.int64, 2 * int(many.sum()))
        self.labels, self.targets = flat[::2], flat[1::2]
        self.keys = np.repeat(np.arange(len(states)), many) * 256 + self.labels
        sizes, skips = [], []
        for s in states:
            n = int(s[0])
            for target in s[2::2]:
                skips.append(n)
                n += sizes[target]
            sizes.append(n)
        self.skips = np.array(skips, dtype=np.int64)

    @staticmethod
    def _finish(path: list[list], last: bytes, depth: int, known: dict[tuple, int]) -> None:
        """Replace what lies beyond `depth` on the path by states, equal ones by the same."""
        while len(path) > depth + 1:
            state = tuple(path.pop())
            path[-1] += (last[len(path) - 1], known.setdefault(state, len(known)))

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge of each state with this label, and whether there is one."""
        key = state * 256 + label
        edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return edge, self.keys[edge] == key

    def near(self, words: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asking word, number of the word found) of all words one edit away behind the first `exact` bytes of `words`."""
        if not len(self.keys) or not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        base = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words) + b"\0\0", dtype=np.uint8).astype(np.int64)
        state, number, alive = np.full(len(words), self.root), np.zeros(len(words), np.int64), np.arange(len(words))
        wrong: list[tuple[np.ndarray, ...]] = []  # asking word, state, number, place in it, all with the error behind them
        place = 0
        while len(alive):
            free = alive[exact[alive] <= place]
            if len(free):
                wrong += self._errors(free, state[free], number[free], place, text[base[free] + place], text[base[free] + place + 1], size[free])
            alive = alive[size[alive] > place]
            edge, there = self.step(state[alive], text[base[alive] + place])
            alive, edge = alive[there], edge[there]
            state[alive] = self.targets[edge]
            number[alive] += self.skips[edge]
            place += 1
        who, state, number, at = (np.concatenate(x) for x in zip(*wrong, strict=True))
        found = []
        while len(who):
            done = at == size[who]
            hit = done & self.final[state]
            found.append((who[hit], number[hit]))
            who, state, number, at = (x[~done] for x in (who, state, number, at))
            edge, there = self.step(state, text[base[who] + at]) if len(who) else (np.zeros(0, np.int64), np.zeros(0, bool))
            who, number, at, edge = who[there], number[there], at[there] + 1, edge[there]
            state, number = self.targets[edge], number + self.skips[edge]
        who, number = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return who, number

    def _errors(self, who: np.ndarray, state: np.ndarray, number: np.ndarray, place: int, here: np.ndarray, beyond: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """What the error at this place leads to: another byte for the word's, one more before it, or none."""
        inside = size > place
        many = self.first[state + 1] - self.first[state]
        of = np.repeat(np.arange(len(who)), many)
        edge = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + self.first[state][of]
        other = ~inside[of] | (self.labels[edge] != here[of])  # one more of the same byte counts where the run ends
        of, edge = of[other], edge[other]
        on, after = who[of], number[of] + self.skips[edge]
        replaced = inside[of]
        # of a run of the same byte, the last goes
        less = inside & ((size == place + 1) | (here != beyond))
        return [
            (on, self.targets[edge], after, np.full(len(of), place)),
            (on[replaced], self.targets[edge[replaced]], after[replaced], np.full(int(replaced.sum()), place + 1)),
            (who[less], state[less], number[less], np.full(int(less.sum()), place + 1)),
        ]


def best_near(index: dict[bytes, int], asking: list[bytes], backward: bool) -> Iterator[tuple[str, int, int, str]]:
    """For each asking word: the word, its number of near words in `index` (word to n), n and text of the best of them."""
    words = sorted(index)
    n = np.array([index[w] for w in words], dtype=np.int64)
    true = [w[::-1] for w in words] if backward else words
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=true.__getitem__)] = np.arange(len(words))
    automaton = Automaton(words)
    for at in range(0, len(asking), AT_ONCE):
        part = asking[at : at + AT_ONCE]
        size = np.array([len(w) for w in part], dtype=np.int64)
        who, number = automaton.near(part, size - size // 2 if backward else size // 2)
        if backward and len(who):  # what shares the first half is found forwards
            new = np.array([words[v][-(len(part[q]) // 2) :] != part[q][-(len(part[q]) // 2) :] for q, v in zip(who.tolist(), number.tolist(), strict=True)])
            who, number = who[new], number[new]
        if not len(who):
            continue
        order = np.lexsort((rank[number], -n[number], who))
        who, number = who[order], number[order]
        head = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        for q, many, v in zip(who[head].tolist(), np.diff(np.r_[head, len(who)]).tolist(), number[head].tolist(), strict=True):
            own = part[q][::-1] if backward else part[q]
            yield own.decode("latin-1"), many, int(n[v]), true[v].decode("latin-1")


def dealt(words: DataFrame) -> DataFrame:
    """Rows (key, backward, text, n, asks) of every word for every half by which it can be found, and which one it asks by."""
    size = F.length("word")
    first_half = lambda length: F.floor(length / 2).cast("int")
    second_half = lambda length: length - first_half(length)
    sides = []
    for backward, half in ((False, first_half), (True, second_half)):
        text = F.reverse("word") if backward else F.col("word")
        places = F.array_distinct(F.array(*[half(x) for x in (size - 1, size, size + 1)]))
        sides.append(words.select(F.lit(backward).alias("backward"), text.alias("text"), "n", half(size).alias("_own"), F.explode(places).alias("_half")))
    key = F.xxhash64("backward", "_half", F.substring("text", F.lit(1), F.col("_half")))  # halves that share a key only share a task
    return sides[0].unionByName(sides[1]).select(key.alias("key"), "backward", "text", "n", (F.col("_half") == F.col("_own")).alias("asks"))


def near_words(words: DataFrame, in_task: int = IN_TASK, hot: int = HOT) -> DataFrame:
    """word, n_near, and n and text of the greatest near word (`best_n`, `best`), for each word that has one; `words`: word, n."""
    rows = dealt(words)
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("asking"))
    split = F.ceil(F.col("rows") / hot)
    total, more = shared.agg(F.sum("rows"), F.sum((split - 1) * F.col("asking"))).first()
    parts = shared.where(F.col("rows") > hot).select("key", split.cast("int").alias("parts")) if more else None
    rows = rows.join(maybe_broadcast(cut(parts), (total or 0) // hot), "key", "left") if more else rows.withColumn("parts", F.lit(None).cast("int"))
    # a word of a split key lies in one part of it, and asks in all of them
    own = F.pmod(F.xxhash64("text"), F.coalesce("parts", F.lit(1))).cast("int")
    places = F.when(F.col("asks") & F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    rows = rows.withColumn("part", F.explode(places)).select("key", "part", F.col("parts").isNotNull().alias("alone"), "backward", "text", "n", "asks", (F.col("part") == own).alias("lies"))
    rows = rows.repartition(max(1, ((total or 0) + (more or 0)) // in_task + 1), "key", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[dict[bytes, int], list[bytes]]] = {}  # parts of split keys by themselves, all else by direction
        for batch in batches:
            for key, part, alone, backward, text, n, asks, lies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                index, asking = groups.setdefault((backward, key, part) if alone else (backward,), ({}, []))
                word = text.encode("latin-1")
                if lies:
                    index[word] = n
                if asks:
                    asking.append(word)
        for name in list(groups):
            found = list(best_near(*groups.pop(name), name[0]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["word", "n_near", "best_n", "best"])

    found = rows.mapInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    sums = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b"))
    return sums.select("word", "n_near", (-F.col("_b.less")).alias("best_n"), F.col("_b.best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Rows (word, form) with `root`, where the chain of forms that begins at the word ends. A chain is followed in steps that double.

    At most as many words share a form as are near it, so no key of these joins grows with the corpus.
    """
    now = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    while True:
        beyond = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        on = now.where("open").join(beyond, F.col("root") == F.col("_word"), "left")
        moved = on.select("word", F.coalesce("_root", "root").alias("root"), F.col("_word").isNotNull().alias("open"))
        now = cut(now.where("not open").unionByName(moved))
        if not now.where("open").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the documents."""
    words = cut(word_counts(docs))
    near = near_words(words)
    fits = F.col("best_n") >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    rows = cut(rows)
    roots = with_roots(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
