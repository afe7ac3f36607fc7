"""Applying code patches to a table of files. The result is new rows; nothing is changed in place."""

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import RARE_BREAKS, contains_any, once, split_lines, strip
from auditlake.skew import lookup_join, shuffled
from auditlake.workspace import stored

PATCHES_PER_ROUND = 1000
FILE = ["repo", "file"]
KEY = ["ord", "line", "original_code", "new_code", "copy"]


def _line_fits(present: Column, original: Column) -> Column:
    """True if a patch that names the original text may replace this line."""
    wanted, bare = strip(original), strip(present)
    return (original == "") | F.contains(bare, wanted) | F.contains(wanted, bare)


def _apply_one(state: Column, patch: Column) -> Column:
    """Content and statuses after one more patch of the file."""
    content = state["content"]
    lines = split_lines(content)
    line, new = patch["line"], patch["new_code"]
    original = F.coalesce(patch["original_code"], F.lit(""))
    wanted = strip(original)
    by_line = (
        new.isNotNull() & line.isNotNull() & line.between(1, F.size(lines)) & _line_fits(F.get(lines, line - 1), original)
    )
    by_text = new.isNotNull() & (original != "") & F.contains(content, wanted)
    rewritten = F.concat(
        F.array_join(F.transform(lines, lambda text, i: F.when(i == line - 1, new).otherwise(text)), "\n"),
        F.lit("\n"),
    )
    # A blank original that is not empty strips to '': text replacement then inserts between all characters.
    spread = F.concat(
        strip(new),
        F.array_join(
            F.transform(F.filter(F.split(content, ""), lambda c: c != ""), lambda c: F.concat(c, strip(new))), ""
        ),
    )
    replaced = F.when(wanted == "", spread).otherwise(F.replace(content, wanted, strip(new)))
    status = F.when(by_line, "line").when(by_text, "text").otherwise("failed")
    return F.struct(
        F.when(by_line, rewritten).when(by_text, replaced).otherwise(content).alias("content"),
        F.concat(state["statuses"], F.array(status)).alias("statuses"),
    )


def _fold(content: Column, patches: Column) -> Column:
    """All patches of the array in order."""
    start = F.struct(content.alias("content"), F.array().cast("array<string>").alias("statuses"))
    return F.aggregate(patches, start, _apply_one)


def _merge(content: Column, edits: Column) -> Column:
    """Content with the given lines (sorted structs of line, text) replaced: stretches between them are copied once."""

    def merged(lines: Column) -> Column:
        def stretch(edit: Column, i: Column) -> Column:
            before = F.coalesce(F.get(edits, i - 1)["line"], F.lit(0))
            return F.concat(F.slice(lines, before + 1, edit["line"] - before - 1), F.array(edit["text"]))

        tail = F.slice(lines, F.element_at(edits, -1)["line"] + 1, F.size(lines))
        return F.concat(F.array_join(F.concat(F.flatten(F.transform(edits, stretch)), tail), "\n"), F.lit("\n"))

    return F.when(F.size(edits) > 0, once(split_lines(content), merged)).otherwise(content)


def _line_hits(placed: DataFrame, current: DataFrame) -> DataFrame:
    """Whether each patch finds its line, if only single lines were replaced before it.

    Then line numbers stay and the patches of one line depend on each other only: each line has its own chain. A chain
    of any length passes sorted through one task, which holds the line as the last patch has left it.
    """
    wanted = placed.groupBy(*FILE).agg(F.collect_set("line").alias("lines"))
    texts = current.select(*FILE, "content").join(shuffled(wanted), FILE).select(
        *FILE,
        F.inline(
            once(
                split_lines(F.col("content")),
                lambda text: F.transform("lines", lambda n: F.struct(n.alias("line"), strip(F.get(text, n - 1)).alias("bare"))),
            )
        ),
    )
    original = F.coalesce(F.col("original_code"), F.lit(""))
    steps = placed.select(
        *FILE, *KEY, strip(F.col("new_code")).alias("bare"), F.when(original != "", strip(original)).alias("wanted"), F.lit(True).alias("patch")
    )
    chains = texts.withColumn("patch", F.lit(False)).unionByName(steps, allowMissingColumns=True)
    chains = chains.withColumns({"bare": F.col("bare").cast("binary"), "wanted": F.col("wanted").cast("binary")})
    sorted_chains = chains.repartition(*FILE, "line").sortWithinPartitions(*FILE, "line", "patch", *KEY)
    fields = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*FILE, *KEY]) + ", hit boolean"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, begun = [], False  # the line, in each row of its file
        for batch in batches:
            taken, hits = [], []
            for i, (bare, wanted, patch) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bare", "wanted", "patch")))):
                if not patch:
                    present, begun = [*present, bare] if begun else [bare], True
                    continue
                begun = False
                for k, text in enumerate(present):
                    hit = wanted is None or wanted in text or text in wanted
                    if hit:
                        present[k] = bare
                    taken.append(i)
                    hits.append(hit)
            rows = batch.select([*FILE, *KEY]).take(pa.array(taken, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hits, pa.bool_())], [*FILE, *KEY, "hit"])

    return sorted_chains.select(*FILE, *KEY, "bare", "wanted", "patch").mapInArrow(follow, schema)


def _judge(pending: DataFrame, current: DataFrame) -> DataFrame:
    """Pending patches with hit, status and whether they are settled.

    A file's patches are settled up to the first one that needs the whole text: its line does not fit and it names
    a text. A patch that puts several lines in place of one is settled itself and stops those after it, whose line
    numbers it moves.
    """
    placed = lookup_join(pending, shuffled(current.select(*FILE, "n_lines")), FILE, KEY)
    on_line = F.coalesce(F.col("new_code").isNotNull() & F.col("line").between(1, F.col("n_lines")), F.lit(False))
    near, far = placed.filter(on_line), placed.filter(~on_line)
    outcomes = _line_hits(near, current).withColumn("n_lines", F.lit(0)).unionByName(far.withColumn("hit", F.lit(False)))
    names_text = F.coalesce(F.col("original_code"), F.lit("")) != ""
    needs_text = names_text & F.col("new_code").isNotNull() & F.col("n_lines").isNotNull()
    several = contains_any(F.col("new_code"), ["\n", *RARE_BREAKS])
    outcomes = stored(
        outcomes.select(
            *FILE,
            *KEY,
            "hit",
            F.when(F.col("hit"), F.when(several, 1)).otherwise(F.when(needs_text, 0)).alias("stop"),
        ),
        "patch-outcomes",
    )
    key = F.struct(*KEY)
    stops = outcomes.filter("stop IS NOT NULL").groupBy(*FILE).agg(F.min(F.struct(key.alias("key"), "stop")).alias("s"))
    settled = F.col("s").isNull() | (key < F.col("s.key")) | ((key == F.col("s.key")) & (F.col("s.stop") == 1))
    return lookup_join(outcomes, shuffled(stops), FILE, KEY).select(
        *FILE, *KEY, "hit", F.when(F.col("hit"), "line").otherwise("failed").alias("status"), settled.alias("settled")
    )


def _with_lines(contents: DataFrame) -> DataFrame:
    return contents.withColumn("n_lines", F.size(split_lines(F.col("content"))))


def _file_rows(contents: DataFrame) -> DataFrame:
    return contents.select(
        "repo",
        F.col("file").alias("path"),
        F.octet_length("content").cast("bigint").alias("size"),
        "content",
    )


def patch_apply(
    files: DataFrame, patches: DataFrame, patches_per_round: int = PATCHES_PER_ROUND
) -> tuple[DataFrame, DataFrame]:
    """Apply patches (repo, file, ord, line, original_code, new_code) to files, one row per (repo, path).

    Returns the new rows of the changed files (repo, path, size, content) and one status row
    per patch: 'line' (the line was replaced), 'text' (all occurrences were replaced) or
    'failed' (nothing matched, the patch has no new code, or there is no such file).

    Each patch of a file sees the text left by the one before. Replacements of single lines are followed
    line by line, spread over tasks, and put into the text in one merge, whatever their number. From the
    first patch on that needs the whole text (see ``_judge``), the file's next ``patches_per_round`` patches are folded
    in order inside its row; a file with more patches goes through further rounds, finished files do not.
    """
    copies = Window.partitionBy(*FILE, *KEY[:-1]).orderBy("ord")
    in_file = Window.partitionBy(*FILE).orderBy(*KEY)
    pending = patches.select(*FILE, *KEY[:-1]).withColumn("copy", F.row_number().over(copies))
    texts = files.select("repo", F.col("path").alias("file"), "content").filter("content IS NOT NULL")
    touched = texts.join(shuffled(patches.select(*FILE).distinct()), FILE, "left_semi")
    current = stored(_with_lines(touched.withColumn("changed", F.lit(False))), "patch-files")
    results, statuses = [], []
    while True:
        judged = stored(_judge(pending, current), "patches-judged")
        settled, rest = judged.filter("settled"), judged.filter("NOT settled").select(*FILE, *KEY)
        last = F.struct(*KEY)
        edits = settled.filter("hit").groupBy(*FILE, "line").agg(F.max_by("new_code", last).alias("text"))
        edits = edits.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("edits"))
        rest = rest.withColumn("turn", F.row_number().over(in_file))
        following = rest.filter(F.col("turn") <= patches_per_round).groupBy(*FILE)
        following = following.agg(F.array_sort(F.collect_list(last)).alias("patches"))
        merged = current.join(shuffled(edits), FILE, "left").withColumn("content", _merge(F.col("content"), F.col("edits")))
        folded = merged.join(shuffled(following), FILE, "left").withColumn("state", _fold(F.col("content"), F.col("patches")))
        by_fold = F.coalesce(F.exists("state.statuses", lambda status: status != "failed"), F.lit(False))
        after = folded.select(
            *FILE,
            F.coalesce("state.content", "content").alias("content"),
            (F.col("changed") | F.col("edits").isNotNull() | by_fold).alias("changed"),
            F.arrays_zip(F.col("patches.ord").alias("ord"), F.col("state.statuses").alias("status")).alias("done"),
        )
        after = stored(_with_lines(after), "patch-files")
        statuses.append(settled.select(*FILE, "ord", "status"))
        statuses.append(after.select(*FILE, F.inline("done")))
        left = stored(rest.filter(F.col("turn") > patches_per_round).drop("turn"), "patches-left")
        waiting = left.select(*FILE).distinct()
        results.append(after.filter("changed").join(shuffled(waiting), FILE, "left_anti"))
        if left.isEmpty():
            break
        pending, current = left, after.drop("done").join(shuffled(waiting), FILE, "left_semi")
    every = [reduce(DataFrame.unionByName, parts) for parts in (results, statuses)]
    return _file_rows(every[0]), every[1]
