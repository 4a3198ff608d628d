"""Name matching in batch: a table of queries against a table of files.

Nothing here compares all queries with all names. Candidates come from
equi-joins on words, on word runs, or on the first letters of word pieces;
every score is then computed on candidates only. Equal names are scored once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.classify import query_intent
from ..functions.names import core_query, distinctive, ext_flags, is_distinctive, normalize_address, normalize_name, strip_filler
from ..functions.text import bind, computed, explode_once, nonempty, string_array, words
from ..session import apart, cut, measured

PIECE = 8


def _word_rows(df: DataFrame, text: str, out: str = "word") -> DataFrame:
    return explode_once(df, F.array_distinct(words(F.col(text))), out)


def word_pieces(vocabulary: DataFrame, sizes: Column, word: str = "word") -> DataFrame:
    """Every run of letters of each word that is as long as one of ``sizes``: (word, piece).

    The vocabulary is distinct words, and pieces grow linearly with word
    length. A run that occurs twice in a word comes twice.
    """
    starts = vocabulary.select(word, F.explode(F.sequence(F.lit(1), F.length(word))).alias("_at"), sizes.alias("_sizes"))
    runs = starts.select(word, "_at", F.explode("_sizes").alias("_n")).filter(F.col("_at") + F.col("_n") <= F.length(word) + 1)
    return runs.select(word, F.substring(F.col(word), F.col("_at"), F.col("_n")).alias("piece"))


def contained_pairs(probes: DataFrame, targets: DataFrame, probe: str = "probe", target: str = "target") -> DataFrame:
    """All pairs where a probe is a plain substring of a target.

    Both sides are distinct normalised strings. Each word of a contained probe
    lies inside one word of the target, so a probe is looked up by one of its
    words: the one that is in the fewest targets, then the longest. That word
    meets the target vocabulary through its first letters, and the pairs found
    are checked in full. Only as many letters as some key has are cut out of
    the target words.
    """
    target_words = _word_rows(targets.select(target), target)
    spread = cut(target_words.groupBy("word").agg(F.count("*").alias("df")))
    probe_words = measured(cut(_word_rows(probes.select(probe), probe)))
    known = spread.join(probe_words.select("word").distinct(), "word", "left_semi")
    key_word = cut(
        probe_words.join(known, "word", "left").groupBy(probe)
        .agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), -F.length("word"), "word")).alias("key_word"))
    )
    keys = key_word.select("key_word").distinct().withColumn("piece", F.substring("key_word", 1, PIECE))
    firsts = keys.agg(F.array_join(F.array_sort(F.collect_set(F.left("key_word", F.lit(1)))), "")).scalar()
    held = spread.select("word").filter(F.call_function("translate", F.col("word"), firsts, F.lit("")) != F.col("word"))
    found = cut(
        word_pieces(held, keys.agg(F.collect_set(F.length("piece"))).scalar())
        .join(measured(cut(keys)), "piece")
        .filter(F.col("word").contains(F.col("key_word")))
        .select("word", "key_word").distinct()
    )
    return (
        target_words.join(measured(cut(key_word.join(found, "key_word"))), "word")
        .filter(F.col(target).contains(F.col(probe)))
        .select(probe, target)
        .distinct()
    )


def containable(probes: DataFrame, targets: DataFrame, probe: str, target: str) -> DataFrame:
    """Probes without those that can be in no target: what stands between the first and the last word must be whole words there.

    A probe goes when no target has one of these words, or two that follow each other.
    """
    asked_words = words(F.col(probe))
    between = F.slice(asked_words, 2, F.greatest(F.size(asked_words) - 2, F.lit(0)))
    runs = cut(_word_pairs(probes.select(probe), between))
    asked = cut(runs.select("run").distinct())
    there = cut(_word_pairs(targets.select(target), words(F.col(target))).select("run").join(measured(asked), "run", "left_semi").distinct())
    gone = runs.join(asked.join(there, "run", "left_anti"), "run").select(probe).distinct()
    return probes.join(gone, probe, "left_anti")


def _word_pairs(df: DataFrame, found: Column) -> DataFrame:
    """Rows of words and of every two that follow each other, as ``run``."""
    follow = F.zip_with("_words", F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return explode_once(computed(df, _words=found), F.concat("_words", F.filter(follow, lambda p: p.isNotNull())), "run").drop("_words")


def endable(probes: DataFrame, targets: DataFrame, probe: str, target: str) -> DataFrame:
    """Probes without those that can be in no target: the last word must begin a word there, or be in one if it is the only word.

    Meant for many probes and few targets: a probe is looked up by the first
    PIECE letters of its last word, without a shuffle while the targets' words are few.
    """
    vocabulary = cut(_word_rows(targets.select(target), target).select("word").distinct())
    sizes = F.sequence(F.lit(1), F.lit(PIECE))
    begin = vocabulary.select(F.explode(F.transform(sizes, lambda k: F.left("word", k))).alias("_end"), F.lit(False).alias("_only"))
    inside = word_pieces(vocabulary, sizes).select(F.col("piece").alias("_end"), F.lit(True).alias("_only"))
    ends = measured(cut(begin.unionByName(inside).distinct()))
    end = F.left(F.substring_index(probe, " ", -1), F.lit(PIECE))
    return probes.withColumn("_end", end).withColumn("_only", ~F.col(probe).contains(" ")).join(ends, ["_end", "_only"], "left_semi").drop("_end", "_only")


def query_side(norm_q: Column, core_q: Column) -> Column:
    """What scoring needs of a query, computed once per query."""
    asked, core = F.array_distinct(words(norm_q)), F.array_distinct(words(core_q))
    strong_core = F.filter(F.array_except(core, string_array(rules.QUERY_STOP_WORDS)), is_distinctive)
    return F.struct(
        norm_q.alias("q"), core_q.alias("c"), asked.alias("words"), F.size(asked).alias("asked"),
        F.filter(asked, is_distinctive).alias("strong"), strong_core.alias("strong_core"), F.size(core).alias("core"),
    )


def name_side(name: Column) -> Column:
    """What scoring needs of a name, computed once per name."""
    distinct = F.array_distinct(words(name))
    return F.struct(
        name.alias("n"), distinct.alias("words"), F.size(words(name)).alias("tokens"),
        F.size(F.filter(distinct, is_distinctive)).alias("strong"),
    )


def word_score(q: Column, shared: Column, strong: Column, covered: Column, name_strong: Column) -> Column:
    """Score of a name by the numbers of words it shares with a query: any, distinctive, and distinctive of its core."""
    coverage = covered / F.greatest(name_strong, F.lit(1))
    core_ratio = covered / F.greatest(q["core"], F.lit(1))
    return (
        F.when(strong == 0, F.lit(0.0))
        .when((covered >= 2) & (coverage >= 0.5) & (core_ratio >= 0.7), 100.0 + 5.0 * covered + 20.0 * core_ratio)
        .when((covered >= 3) & (coverage >= 0.4), 100.0 + 5.0 * covered)
        .otherwise(30.0 * (shared / q["asked"]) + 5.0 * strong)
    )


def side_score(q: Column, n: Column) -> Column:
    """Score of a name side for a query side."""
    value = F.struct(
        F.size(F.array_intersect(q["words"], n["words"])).alias("shared"),
        F.size(F.array_intersect(q["strong"], n["words"])).alias("strong"),
        F.size(F.array_intersect(q["strong_core"], n["words"])).alias("covered"),
    )

    def by_words(v: Column) -> Column:
        return word_score(q, v["shared"], v["strong"], v["covered"], n["strong"])

    name, raw, core = n["n"], q["q"], q["c"]
    return (
        F.when((name == raw) | (name == core), F.lit(1000.0))
        .when(name.contains(raw) | name.contains(core), 100.0 + F.lit(50.0) / F.length(name))
        .when(raw.contains(name) | core.contains(name), 100.0 + 10.0 * n["tokens"])
        .otherwise(bind(value, by_words))
    )


def match_score(norm_q: Column, core_q: Column, name: Column) -> Column:
    """Score of a normalised name for a normalised query and its filler-free core."""
    return side_score(query_side(norm_q, core_q), name_side(name))


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group with their rank; the limit also runs map-side."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


#: Words in more names than this are frequent: names that share only such words are listed by the words they share.
RARE_NAMES = 200
#: Names that are read of a list first, times those wanted.
FRONT = 4
#: Most words of a list; names that share more are in lists of so many of them.
LIST_WORDS = 4


def name_items(name_words: DataFrame, items: DataFrame) -> DataFrame:
    """``(items, strong, norm, at)``: the items of each name that has a distinctive one, and where it stands in every list.

    ``items (word, distinctive, df)`` are the words that lists are made of.
    """
    return (
        name_words.join(items, "word").groupBy("norm", "first_uri", "strong")
        .agg(F.array_sort(F.collect_list(F.struct("word", "distinctive", "df"))).alias("items"))
        .filter(F.exists("items", lambda i: i["distinctive"]))
        .select("items", "strong", "norm", _place().alias("at"))
    )


def word_lists(held: DataFrame) -> DataFrame:
    """``(items, strong, names, words, key)``: the lists that names with these items are in, all sets of up to LIST_WORDS items.

    Names that hold the same items are in the same lists, so sets are made once
    for all of them. A list holds a distinctive word and is known by its words
    and the number of distinctive words in its names. ``key`` is its rarest word.
    """
    alike = held.groupBy("items", "strong").agg(F.count("*").alias("names"))
    grown = F.aggregate(
        "items", F.array(F.slice("items", 1, 0)),
        lambda sets, i: F.concat(sets, F.transform(F.filter(sets, lambda x: F.size(x) < LIST_WORDS), lambda x: F.array_append(x, i))),
    )
    lists = explode_once(alike, F.filter(grown, lambda x: F.exists(x, lambda i: i["distinctive"])), "_set")
    key = F.array_min(F.transform("_set", lambda i: F.struct(i["df"].alias("df"), i["word"].alias("w"))))["w"]
    return lists.select("items", "strong", "names", F.transform("_set", lambda i: i["word"]).alias("words"), key.alias("key"))


def _place() -> Column:
    """Where a name stands in every list."""
    return F.concat("first_uri", F.lit("\x00"), "norm")


def list_bound(q: Column, words_: Column, name_strong: Column) -> Column:
    """Score of a name that shares just these words with a query, or the most that one sharing more than lists hold can get."""
    common = lambda side: F.size(F.array_intersect(side, words_))
    exact = word_score(q, F.size(words_), common(q["strong"]), common(q["strong_core"]), name_strong)
    most = F.greatest(120.0 + 5.0 * F.size(q["strong_core"]), 30.0 + 5.0 * F.size(q["strong"]))
    return F.when(F.size(words_) < LIST_WORDS, exact).otherwise(most)


def name_matches(queries: DataFrame, corpus: DataFrame, n: int = 5, query: str = "query", carry: Sequence[str] = (), least: float = 0.0) -> DataFrame:
    """Best ``n`` files per query by name: columns of ``queries``, name, uri, those of ``carry`` from the corpus, score, rank.

    Files that score below ``least`` are no matches; they would rank behind all
    others, so the rows are those of a filter on the score, and lists that
    cannot reach it are not made.

    Scores depend on the normalised name only, so distinct queries are scored
    against distinct names and cut to ``n`` names before files come back in.
    A name in the cut brings its first ``n`` files, which makes the final cut,
    by score and then uri, exact.

    Names are looked up by a query's rare words. Those that share only
    frequent ones are in lists by the words they share, where all score alike:
    a list is read from its front, in order of uri, as long as the score of
    what is left of it could change a query's best ``n``. Longer pieces are
    read each time, so few rounds end every list, and queries ask for nothing
    that could not matter. Names that contain a query are cut to the shortest
    ``n`` of each phrase, which score highest.
    """
    asked = queries.withColumn("norm_q", normalize_name(F.col(query))).filter("norm_q <> ''")
    distinct_q = cut(asked.select("norm_q").distinct().withColumn("core_q", core_query(F.col("norm_q"))))
    query_sides = distinct_q.select("norm_q", query_side(F.col("norm_q"), F.col("core_q")).alias("_q"))
    files = cut(computed(corpus.select("name", "uri", *carry), norm=normalize_name(F.col("name"))).filter("norm <> ''"))
    names = cut(files.groupBy("norm").agg(F.min("uri").alias("first_uri")).withColumn("_n", name_side(F.col("norm"))))

    name_words = explode_once(names.select("norm", "first_uri", "_n"), F.col("_n.words"), "word").select("norm", "first_uri", F.col("_n.strong").alias("strong"), "word")
    asked_words = explode_once(query_sides, F.col("_q.words"), "word").select("norm_q", "word", F.array_contains("_q.strong", F.col("word")).alias("distinctive"))
    vocabulary = asked_words.select("word", "distinctive").distinct()
    spread = cut(name_words.join(measured(cut(vocabulary)), "word").groupBy("word", "distinctive").agg(F.count("*").alias("df")))
    rare = spread.filter(F.col("distinctive") & (F.col("df") <= RARE_NAMES))
    items = spread.filter(~F.col("distinctive") | (F.col("df") > RARE_NAMES))

    phrases = distinct_q.select("norm_q", F.explode(F.array_distinct(F.array("norm_q", "core_q"))).alias("phrase"))
    distinct_phrases = phrases.select("phrase").distinct()
    inside = contained_pairs(cut(containable(distinct_phrases, names, "phrase", "norm")), names.select("norm"), "phrase", "norm")
    inside = names.select("norm", "first_uri").join(measured(cut(inside)), "norm")
    inside = top_n(inside, ["phrase"], [F.length("norm"), F.col("first_uri")], n, "_r").join(phrases, "phrase")
    around = contained_pairs(cut(endable(names.select("norm"), distinct_phrases, "norm", "phrase")), distinct_phrases, "norm", "phrase").join(phrases, "phrase")

    def score(pairs: DataFrame) -> DataFrame:
        return cut(
            names.join(measured(cut(pairs)), "norm").join(query_sides, "norm_q")
            .transform(lambda df: computed(df, score=side_score(F.col("_q"), F.col("_n"))))
            .filter((F.col("score") > 0) & (F.col("score") >= least)).select("norm_q", "norm", "first_uri", "score")
        )

    by_rare = cut(asked_words.select("norm_q", "word").join(rare.select("word"), "word"))
    pairs = (
        name_words.join(measured(by_rare), "word").select("norm_q", "norm")
        .unionByName(inside.select("norm_q", "norm")).unionByName(around.select("norm_q", "norm")).distinct()
    )
    scored = score(pairs)
    held = name_items(name_words, measured(items))
    sets = cut(word_lists(held))
    sizes = sets.groupBy("words", "key", "strong").agg(F.sum("names").alias("rows"))
    # What a query may take from a list, and up to where the list has been read for all queries so far.
    open_lists = cut(
        sizes.join(asked_words.select("norm_q", F.col("word").alias("key")), "key").join(query_sides, "norm_q")
        .filter(F.size(F.array_except("words", F.col("_q.words"))) == 0)
        .select("norm_q", "words", "strong", "rows", list_bound(F.col("_q"), F.col("words"), F.col("strong")).alias("bound"))
        .filter((F.col("bound") > 0) & (F.col("bound") >= least)).withColumn("read", F.lit(0)).withColumn("last", F.lit(""))
    )
    if not open_lists.isEmpty():
        wanted = sets.join(open_lists.select("words", "strong").distinct(), ["words", "strong"])
        lists = cut(held.join(measured(cut(wanted.select("items", "strong", "words"))), ["items", "strong"]).select("words", "strong", "norm", "at"))
    block = n * FRONT
    while not open_lists.isEmpty():
        wanted = open_lists.groupBy("words", "strong").agg(F.max("last").alias("last"), F.max("read").alias("read"))
        left = lists.join(wanted, ["words", "strong"]).filter(F.col("at") > F.col("last"))
        piece = cut(top_n(left, ["words", "strong"], [F.col("at")], block, "_r").select("words", "strong", "norm", "at"))
        found = open_lists.select("norm_q", "words", "strong").join(piece, ["words", "strong"]).select("norm_q", "norm").distinct()
        scored = scored.unionByName(score(found.join(scored, ["norm_q", "norm"], "left_anti")))
        worst = top_n(scored, ["norm_q"], [F.col("score").desc(), F.col("first_uri")], n, "_r").filter(F.col("_r") == n)
        worst = worst.select("norm_q", "score", _place().alias("at"))
        ends = piece.groupBy("words", "strong").agg(F.max("at").alias("end"), F.count("*").alias("more"))
        after = open_lists.join(ends, ["words", "strong"]).withColumn("read", F.col("read") + F.col("more"))
        after = after.withColumn("last", F.col("end")).drop("end", "more").filter("read < rows")
        sure = (F.col("score") > F.col("bound")) | ((F.col("score") == F.col("bound")) & (F.col("at") <= F.col("last")))
        open_lists = cut(after.join(worst, "norm_q", "left").filter(F.col("score").isNull() | ~sure).drop("score", "at"))
        block *= 4

    best = cut(top_n(scored, ["norm_q"], [F.col("score").desc(), F.col("first_uri")], n).select("norm_q", "norm", "score"))
    first = top_n(files.join(best.select("norm").distinct(), "norm", "left_semi"), ["norm"], [F.col("uri")], n, "_r").drop("_r")
    ranked = top_n(best.join(first, "norm"), ["norm_q"], [F.col("score").desc(), F.col("uri")], n)
    return asked.join(ranked, "norm_q").drop("norm_q", "norm")


def anchor_limit(folder_count: Column) -> Column:
    """Largest number of folders a word may occur in and still identify one."""
    return F.greatest(F.lit(3), F.least(F.lit(5), F.floor(folder_count * F.lit(0.005)))).cast("bigint")


def word_runs(norm: Column, longest: Column) -> Column:
    """All runs of up to ``longest`` consecutive words."""
    w = words(norm)
    size = F.size(w)
    runs = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.transform(
            F.sequence(F.lit(1), F.least(longest.cast("int"), size - i + 1)), lambda k: F.array_join(F.slice(w, i, k), " ")
        ),
    )
    return F.when(size > 0, F.array_distinct(F.flatten(runs))).otherwise(string_array([]))


def contained_folders(queries: DataFrame, folders: DataFrame, key: str = "norm_q") -> DataFrame:
    """Folders whose words occur as a run in the query: (key, folder).

    Word boundaries make containment an equality with one of the query's word
    runs, no longer than the longest folder name.
    """
    named = folders.withColumn("f_norm", normalize_name(F.col("folder"))).filter("f_norm <> ''").select("folder", "f_norm")
    longest = named.agg(F.coalesce(F.max(F.size(words(F.col("f_norm")))), F.lit(1)).alias("n")).scalar()
    bounded = queries.select(key).distinct().withColumn("_longest", longest)
    runs = explode_once(bounded, word_runs(F.col(key), F.col("_longest")), "f_norm").drop("_longest")
    return runs.join(named, "f_norm").select(key, "folder")


def detect_folders(queries: DataFrame, folders: DataFrame, query: str = "query",
                   noise: Sequence[str] = rules.CATEGORY_NOISE_WORDS) -> DataFrame:
    """Folder each query is about: adds ``folder`` and ``pass`` (NULL without a match).

    Passes, the first that finds something wins: 1 equal names, 2 the longest
    contained name, 3 shared rare words, 4 all distinctive words of the folder.
    Ties go to the longer name, then the smaller one.
    """
    named = cut(folders.select("folder").distinct().withColumn("f_norm", normalize_name(F.col("folder"))).filter("f_norm <> ''"))
    asked = cut(queries.withColumn("norm_q", normalize_name(F.col(query))))
    q = cut(asked.filter("norm_q <> ''").select("norm_q").distinct())

    equal_keys = q.select("norm_q", F.explode(F.array_distinct(F.array("norm_q", strip_filler(F.col("norm_q"))))).alias("f_norm"))
    equal = equal_keys.join(named, "f_norm").select("norm_q", "folder", F.lit(1).alias("pass"), F.lit(0).alias("s1"), F.lit(0).alias("s2"))
    inside = contained_folders(q, named).select("norm_q", "folder", F.lit(2).alias("pass"), F.lit(0).alias("s1"), F.lit(0).alias("s2"))

    noise_words, stop_words = string_array(noise), string_array(rules.QUERY_STOP_WORDS)
    folder_words = _word_rows(named, "f_norm")
    freq = named.select(F.explode(words(F.col("f_norm"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    limit = named.agg(anchor_limit(F.greatest(F.count("*"), F.lit(1))).alias("n")).scalar()
    anchors = freq.withColumn("limit", limit).filter(F.col("freq") <= F.col("limit")).filter(~F.array_contains(noise_words, F.col("word"))).select("word")
    q_words = q.withColumn("q_words", F.filter(F.array_distinct(words(F.col("norm_q"))), lambda w: is_distinctive(w) & ~F.array_contains(stop_words, w)))
    anchored = (
        q_words.select("norm_q", "q_words", F.explode("q_words").alias("word"))
        .join(folder_words.join(anchors, "word"), "word")
        .groupBy("norm_q", "folder", "f_norm")
        .agg(F.count("*").alias("s1"), F.first("q_words").alias("q_words"))
        .select(
            "norm_q", "folder", F.lit(3).alias("pass"), F.col("s1").cast("int").alias("s1"),
            F.size(F.array_intersect("q_words", F.array_distinct(words(F.col("f_norm"))))).alias("s2"),
        )
    )

    # Pass 4 looks a folder up by its rarest word that is not noise.
    need = named.withColumn("need", F.filter(F.array_distinct(words(F.col("f_norm"))), is_distinctive)).withColumn(
        "lead", F.array_except("need", noise_words)
    )
    lead = (
        need.filter(F.size("lead") > 0)
        .select("folder", "need", F.explode("lead").alias("word"))
        .join(freq, "word")
        .groupBy("folder", "need")
        .agg(F.min_by("word", F.struct("freq", "word")).alias("word"))
    )
    all_words = (
        _word_rows(q, "norm_q")
        .join(lead, "word")
        .filter(F.size(F.array_except("need", words(F.col("norm_q")))) == 0)
        .select("norm_q", "folder", F.lit(4).alias("pass"), F.lit(0).alias("s1"), F.lit(0).alias("s2"))
    )
    found = equal.unionByName(inside).unionByName(anchored).unionByName(all_words)
    order = [F.col("pass"), F.col("s1").desc(), F.col("s2").desc(), F.length("folder").desc(), F.col("folder")]
    best = top_n(found, ["norm_q"], order, 1, "_r").select("norm_q", "folder", "pass")
    return asked.join(best, "norm_q", "left").drop("norm_q")


def route_matters(queries: DataFrame, corpus: DataFrame, folders: DataFrame, query: str = "query",
                  context: str = "context", strong: float = 100.0) -> DataFrame:
    """Folder a question is about: one it names, else one its carried context names.

    A question that names a file strongly does not inherit the context.
    """
    keys = [query, context]
    asked, folders = queries.select(*keys).distinct(), cut(folders.select("folder").distinct())
    direct = cut(detect_folders(asked, folders, query).withColumnRenamed("folder", "direct").drop("pass"))
    open_ = direct.filter(F.col("direct").isNull() & F.col(context).isNotNull()).select(*keys)
    named = name_matches(open_.select(query).distinct(), corpus, 1, query, least=strong).select(query)
    carried = open_.join(named, query, "left_anti").withColumn("_both", F.concat_ws(" ", context, query))
    inherited = detect_folders(carried, folders, "_both").select(*keys, F.col("folder").alias("inherited"))
    same = (F.col(f"d.{query}") == F.col(f"i.{query}")) & F.col(f"d.{context}").eqNullSafe(F.col(f"i.{context}"))
    return (
        direct.alias("d").join(inherited.alias("i"), same, "left")
        .select(f"d.{query}", f"d.{context}", F.coalesce("direct", "inherited").alias("folder"),
                F.when(F.col("direct").isNotNull(), "query").when(F.col("inherited").isNotNull(), "context").alias("source"))
    )


def rank_folder_files(files: DataFrame, query: str = "query", path_segments: bool = False) -> DataFrame:
    """Add ``score`` to (query, file) rows: wanted type, then query words in the name.

    ``files`` carries ``doc_type``. The path form keeps only the file's own
    name unless ``path_segments``, so a name hit counts four times by default.
    """
    norm_q = normalize_name(F.col(query))
    asked = distinctive(core_query(norm_q), rules.QUERY_STOP_WORDS)
    name_words = words(normalize_name(F.col("name")))
    if path_segments:
        path_words = F.flatten(F.transform(F.split("path", "/"), lambda s: words(normalize_name(s))))
    else:
        path_words = words(normalize_name(F.col("path")))
    hits = lambda found: F.size(F.array_intersect(F.col("_asked"), found))
    boost = F.when(F.col("doc_type") == query_intent(F.col(query)), rules.INTENT_BOOST).otherwise(0.0)
    return (
        files.withColumn("_asked", asked)
        .withColumn("score", boost + hits(name_words) * 3 + hits(path_words))
        .drop("_asked")
    )


def ranked_files(files: DataFrame, n: int, group: Sequence[str] = ("query_id",), **kw) -> DataFrame:
    return top_n(rank_folder_files(files, **kw), list(group), [F.col("score").desc(), F.col("path")], n)


def folder_subject(folder: Column, query: Column, noise: Sequence[str] = rules.CATEGORY_NOISE_WORDS) -> Column:
    """What to look for by name: the folder's distinctive words, else the query."""
    noise_words = string_array(noise)
    kept = F.filter(words(normalize_name(F.coalesce(folder, F.lit("")))), lambda w: is_distinctive(w) & ~F.array_contains(noise_words, w))
    return F.coalesce(nonempty(F.array_join(kept, " ")), query)


def name_union(queries: DataFrame, corpus: DataFrame, n: int = 50) -> DataFrame:
    """Files anywhere whose name matches the query's folder; the subfolder is the parent.

    ``queries`` has ``query_id, query, folder``.
    """
    subject = cut(queries.withColumn("subject", folder_subject(F.col("folder"), F.col("query"))))
    hits = name_matches(subject, corpus, n, "subject", carry=["path"])
    parts = F.split("path", "/")
    flags = ext_flags(F.col("name"))
    return (
        hits.filter(flags["enumerable"])
        .withColumn("is_marker", flags["marker"])
        .withColumn("subfolder", F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("")))
    )


def resolve_score(norm_query: Column, norm_title: Column, rank: Column) -> Column:
    """Re-rank score of a search candidate by its title; ``rank`` starts at 1."""
    base = F.lit(1.0) / rank
    q, t = F.array_distinct(words(norm_query)), F.array_distinct(words(norm_title))
    return (
        F.when(norm_title == "", base)
        .when(norm_title == norm_query, 100.0)
        .when(norm_title.contains(norm_query), 50.0 + base)
        .when(norm_query.contains(norm_title), 40.0 + base)
        .otherwise(10.0 * F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)) + base)
    )


def resolve_names(candidates: DataFrame, group: str = "query_id", others: int = 5) -> DataFrame:
    """Best candidate (rank 1) and up to ``others`` more per query."""
    return top_n(candidates, [group], [F.col("resolve_score").desc(), F.col("rank")], others + 1, "choice")


def photo_lookup(addresses: DataFrame, index: DataFrame, address: str = "address", prop: str = "property") -> DataFrame:
    """Photo entries of an address: equal, all address words in the key, or a
    shared number together with a shared longer word (both plain substrings)."""
    a = addresses.select(address).distinct().withColumn("a_norm", normalize_address(F.col(address)))
    k = index.select(prop).distinct().withColumn("k_norm", normalize_address(F.col(prop)))
    equal = a.join(k, a["a_norm"] == k["k_norm"]).select(address, prop)

    key_words = _word_rows(k, "k_norm")
    spread = key_words.groupBy("word").agg(F.count("*").alias("df"))
    rarest = (
        _word_rows(a, "a_norm").join(spread, "word", "left")
        .groupBy(address, "a_norm")
        .agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    )
    subset = (
        rarest.join(key_words, "word")
        .filter(F.size(F.array_except(words(F.col("a_norm")), words(F.col("k_norm")))) == 0)
        .select(address, prop)
    )

    numbered = a.withColumn("nums", F.regexp_extract_all(F.col(address), F.lit(r"(\d+)"), F.lit(1))).filter(F.size("nums") > 0)
    long_words = numbered.withColumn("probe", F.explode(F.filter(F.array_distinct(words(F.col("a_norm"))), lambda w: ~w.rlike(r"^\d+\z") & (F.length(w) > 2))))
    near = contained_pairs(long_words.select("probe").distinct(), k.select("k_norm").distinct(), "probe", "k_norm")
    both = (
        long_words.join(near, "probe")
        .filter(F.exists("nums", lambda n: F.col("k_norm").contains(n)))
        .join(k, "k_norm")
        .select(address, prop)
    )
    pairs = equal.unionByName(subset).unionByName(both).distinct()
    return addresses.join(pairs, address).join(index, prop)


def segment_similarity(corpus: DataFrame, folders: DataFrame) -> DataFrame:
    """How path segments relate to each folder name: equal, containing, same first 5 or 10 words.

    Segments are counted first, so a segment met on a third of all paths is one row.
    """
    parts = F.split(F.col("path"), "/")
    seg = F.explode(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    segments = (
        corpus.select(seg.alias("s")).groupBy("s").agg(F.count("*").alias("n"))
        .withColumn("seg", normalize_name(F.col("s"))).filter("seg <> ''").groupBy("seg").agg(F.sum("n").alias("n"))
    )
    named = folders.select("folder").distinct().withColumn("f_norm", normalize_name(F.col("folder"))).filter("f_norm <> ''")
    norms, segs = named.select("f_norm").distinct(), segments.select("seg")
    around = contained_pairs(norms, segs, "f_norm", "seg")
    inside = contained_pairs(segs.filter(F.length("seg") >= 10), norms, "seg", "f_norm")
    contains = around.unionByName(inside.select("f_norm", "seg")).distinct()
    lead = lambda c, k: F.when(F.size(words(c)) >= k, F.array_join(F.slice(words(c), 1, k), " "))

    def same_lead(k: int) -> DataFrame:
        left = norms.withColumn("lead", lead(F.col("f_norm"), k)).filter("lead is not null")
        right = segs.withColumn("lead", lead(F.col("seg"), k)).filter("lead is not null")
        return left.join(right, "lead").filter("f_norm <> seg").select("f_norm", "seg")

    kinds = {
        "strict": norms.select("f_norm", F.col("f_norm").alias("seg")),
        "contains": contains.filter((F.col("f_norm") != F.col("seg")) | (F.length("seg") >= 10)),
        "prefix5": same_lead(5),
        "prefix10": same_lead(10),
    }
    out = None
    for kind, pairs in kinds.items():
        rows = pairs.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    counted = out.join(segments, "seg").groupBy("f_norm").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{k}_hits") for k in kinds]
    )
    zero = {f"{k}_hits": 0 for k in kinds}
    return named.join(counted, "f_norm", "left").drop("f_norm").fillna(zero)
