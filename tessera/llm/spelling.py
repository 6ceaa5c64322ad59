"""Spelling variant grouping over a variable-length gram index.

The words of a corpus are counted, and near words (one code point inserted,
deleted or replaced) are found by a gram index in four steps:

1. Gram dictionary. Every word gets ``PAD`` marks at each end. All its grams of 2
   and 3 code points are counted over the distinct words; a gram found more than
   ``FREQUENT`` times is pruned from the dictionary in favour of its extensions.
2. Decomposition. The gram at a place is the shortest one from there that is not
   frequent, or one of ``LONGEST`` code points; a gram inside its predecessor is left out.
3. Affected-gram bound. ``most_affected`` is the largest number of a word's grams
   that one edit can change: those that hold the edited place, and those behind it
   that a gram from before may newly cover (the dictionary tells whether one
   can be that long). The marks leave every word at least one unaffected gram.
4. List merging. A near word keeps all but ``most_affected`` grams, and that holds from both
   sides, so the first grams by (frequency, gram), one more than ``most_affected``, must
   meet: only these shortest lists are merged. Grams meet at the same place, or at
   the next one behind an insertion. Every candidate is verified by its edit
   distance inside the join, so no unverified pair is kept.

Broadcast: counts of grams of 2 and 3 code points over the letters of words and two
marks, at most 92^2 + 92^3 = 787,152 entries whatever the corpus. Gram lists meet in
a join whose skewed lists adaptive execution splits; words are counted with
pre-aggregation.

Defined cases: null text has no words; a null doc_id is the empty text in the
hashed key; equal rows count each; runs of more than ``VERY_LONG`` code points are no words
of a language, their gram lists would grow with the square of their length, so they meet by
their halves and are verified like all others; ties of form go to the smaller word in code-point
order; an empty table gives an empty result; extra columns are ignored."""
from __future__ import annotations

from hashlib import sha1

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, stage

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LONGEST = 2, 4  # code points of a gram
PAD = LONGEST - 1
HEAD, TAIL = "\x01", "\x02"
FREQUENT = 64
VERY_LONG = 64
LEAST_LENGTH, LEAST_COUNT = 7, 2
STEP = 10  # a form is so many times as frequent as its variant
ONE_IN = 31


def words_with_slips(docs: DataFrame, least_length: int = LEAST_LENGTH, one_in: int = ONE_IN) -> DataFrame:
    """(word): every run of letters of ``least_length`` code points or more, lower-cased; where
    ``one_in`` divides the CRC-32 of ``doc_id:run``, one code point is left out."""
    # shorter runs cannot become longer ones
    runs = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    size = F.char_length("run")
    gone = (F.col("h") % size).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), gone), F.substr("run", gone + 2, size))
    word = F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.char_length("word") >= least_length)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of each distinct word with at least ``least_count`` occurrences."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _padded(word: Column) -> Column:
    return F.concat(F.lit(HEAD * PAD), word, F.lit(TAIL * PAD))


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, n): grams of fewer than LONGEST code points over distinct padded words."""
    letters = words.select(F.split(_padded(F.col("word")), "").alias("c"))

    def grams(k):
        return F.transform(F.sequence(F.lit(0), F.size("c") - k), lambda i: F.concat(*(F.get("c", i + j) for j in range(k))))

    every = F.concat(*(grams(k) for k in range(SHORTEST, LONGEST)))
    return letters.select(F.explode(every).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def decompose(word: str, counts: dict[str, int], frequent: int = FREQUENT) -> list[tuple[int, int]]:
    """The variable grams of a padded word as (start, end), none inside another."""
    grams, reach, size = [], 0, len(word)
    for start in range(size - SHORTEST + 1):
        end = start + SHORTEST
        while end < size and end - start < LONGEST and counts.get(word[start:end], 0) > frequent:
            end += 1
        if end > reach:
            grams.append((start, end))
            reach = end
    return grams


def most_affected(word: str, grams: list[tuple[int, int]], counts: dict[str, int], frequent: int = FREQUENT) -> int:
    """The largest number of ``grams`` that one edit of the padded word can change.

    An edited place at or after a gram's start and before its end changes it. One before its
    start does so only if a gram from there may reach the gram's end: it is no
    longer than LONGEST, and what it shares with this word up to the last code
    point but one must be frequent, or it would have ended earlier."""
    size = len(word)
    replaced, inserted = [0] * size, [0] * (size + 1)
    for start, end in grams:
        for i in range(max(end - LONGEST, 0), end):
            inner = end - i - 2  # code points between the place and the last one
            if i >= start or inner < SHORTEST or counts.get(word[i + 1:end - 1], 0) > frequent:
                replaced[i] += 1
            if i > start or (i >= end - LONGEST + 1 and (inner + 1 < SHORTEST or counts.get(word[i:end - 1], 0) > frequent)):
                inserted[i] += 1
    return max(max(replaced[PAD:size - PAD]), max(inserted[PAD:size - PAD + 1]))


def rarest(word: str, counts: dict[str, int], frequent: int = FREQUENT) -> list[tuple[str, int, str, str]]:
    """(gram, place, text before, text behind) of the lists to merge for a word: one gram more than
    one edit can change, by rising frequency; a gram that is taken is taken at all its places."""
    padded = HEAD * PAD + word + TAIL * PAD
    grams = decompose(padded, counts, frequent)
    texts = [padded[a:b] for a, b in grams]

    def order(gram):  # of a gram as long as LONGEST only the parts are counted
        return min(counts.get(gram[:LONGEST - 1], 0), counts.get(gram[1 - LONGEST:], 0)), gram

    last = sorted(map(order, texts))[min(most_affected(padded, grams, counts, frequent), len(grams) - 1)]
    return [(text, a, padded[:a], padded[b:]) for text, (a, b) in zip(texts, grams, strict=True) if order(text) <= last]


def halves(word: str) -> list[tuple[str, int, str, str]]:
    """The same for a very long run: a start and an end that meet those of every near one, as one
    edit leaves one of both whole. Cut for runs as long and for runs shorter by one."""
    size = len(word)
    return list({(part, 0, "", "") for n in (size, size - 1)
                 for part in (HEAD + word[:n // 2], word[size - (n - n // 2):] + TAIL)})


def index_entries(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(gram, place, size, before, behind, word, n): the merged lists' entries of each word of
    (word, n); before and behind: CRC-32 of the text on both sides of the gram."""
    known = gram_counts(words).toArrow()  # at most 92^2 + 92^3 rows, see above
    shared = words.sparkSession.sparkContext.broadcast(dict(zip(known["gram"].to_pylist(), known["n"].to_pylist(), strict=True)))
    names = ["gram", "place", "size", "before", "behind", "word", "n"]

    def entries(batches):
        from zlib import crc32

        import pyarrow as pa

        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(word)
                lists = rarest(word, shared.value, frequent) if size <= VERY_LONG + 1 else []
                if size > VERY_LONG:
                    lists += [(f"{len(g)}:{sha1(g.encode()).hexdigest()}", *rest) for g, *rest in halves(word)]
                rows += [(g, place, size, crc32(x.encode()), crc32(y.encode()), word, n) for g, place, x, y in lists]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return ship(words).select("word", "n").mapInArrow(entries, "gram string, place int, size int, before long, behind long, word string, n long")


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with one code point replaced, or inserted if b is longer; linear in their length."""
    low, high = 0, len(a)  # length of the common start
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a != b and a[low + (len(a) == len(b)):] == b[low + 1:]


def near_words(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(a, a_n, b, b_n): each two words of (word, n) one edit apart, once."""
    entries = stage(index_entries(words, frequent), "grams")
    # from the shorter word, or one of two equally long ones: grams before the edit
    # keep their place, those behind an insertion move by one
    places = F.array(*(F.struct((F.col("place") + moved).alias("place"), (F.col("size") + longer).alias("size")) for moved, longer in ((0, 0), (0, 1), (1, 1))))
    a = entries.select("gram", F.explode(places).alias("to"), F.col("before").alias("a_before"), F.col("behind").alias("a_behind"),
                       F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("size").alias("a_size"))
    a = a.select("gram", "to.*", *a.columns[2:])
    b = entries.withColumnsRenamed({"word": "b", "n": "b_n"})
    # the edit leaves a gram that it does not change with the same text on one side
    one_side = (F.col("a_before") == F.col("before")) | (F.col("a_behind") == F.col("behind"))
    once = (F.col("a_size") < F.col("size")) | (F.col("a") < F.col("b"))
    met, pair = ["gram", "place", "size"], ["a", "a_n", "b", "b_n"]
    # read apart, so that either filter reaches the stored entries
    short = a.filter(F.col("a_size") <= VERY_LONG).join(b.filter(F.col("size") <= VERY_LONG + 1), met)
    short = short.filter(one_side & once & (F.levenshtein("a", "b", 1) == 1)).select(pair)
    # Spark's edit distance takes time by the square of the length
    long = a.filter(F.col("a_size") > VERY_LONG).join(b.filter(F.col("size") > VERY_LONG), met).filter(once).select(pair).distinct()

    def verified(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([one_edit(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_()))

    return short.union(long.mapInArrow(verified, long.schema)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form) that have a form: where their forms end.
    Counts rise along forms, so there is no circle, and the way doubles each round."""
    ways = stage(forms.filter("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("on"))
        further = stage(ways.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "ways")
        ways = further.drop("moved")
        if not further.filter("moved").head(1):
            return ways


def spelling_variants(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus."""
    return group_variants(vocabulary(words_with_slips(docs)), frequent)


def group_variants(words: DataFrame, frequent: int = FREQUENT, step: int = STEP) -> DataFrame:
    """The same of any (word, n)."""
    words = stage(words.select("word", "n"), "words")
    pairs = near_words(words, frequent)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), (-F.col("b_n")).alias("less"), F.col("b").alias("near")),
                             F.struct(F.col("b").alias("word"), (-F.col("a_n")).alias("less"), F.col("a").alias("near"))))
    best = pairs.select(both.alias("r")).select("r.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    is_form = -F.col("best.less") >= step * F.col("n")
    judged = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "judged")
    return judged.join(roots(judged), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
