"""Dependencies from manifest files.

One scan covers all kinds of manifest, whatever their number. Each turns its text into the same kind of event:

* line formats: the dependency stands on one line and is matched where it is;
* block formats: a line means something only together with earlier lines of its file, so its few
  meaningful lines are events, and one window over the events of a file carries the state;
* JSON formats: read with a declared schema, an event for each entry.

Only if block formats are among them is there a shuffle, of events.

Output columns: repo, file, line, package, version, pos (order within a line).
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import after_last, base_name, once, split_lines, strip, words
from auditlake.operators.corpus import select_scan_sets

NAME = "[a-zA-Z0-9_-]+"
DOTTED = "[a-zA-Z0-9.-]+"

# Line formats: pattern, group of the package, group of the version, and whether the line is stripped.
LINE_PATTERNS = {
    "requirements.txt": (rf"(?U)^({NAME})\s*(?:==|<=|>=|~=|<|>)\s*([a-zA-Z0-9.-]+)", 1, 2, True),
    "gemfile.lock": (rf"(?U)^\s{{4}}({NAME})\s*\(([\d.]+)\)", 1, 2, False),
    "pnpm-lock.yaml": (rf"(?U)^/({NAME})/([\d.]+)(?::)?$", 1, 2, True),
    "build.gradle": (rf"['\"]({DOTTED}):({DOTTED}):({DOTTED})['\"]", 2, 3, False),
}


def _by_manifest(choices: dict[str, Column]) -> Column:
    """The value of the row's own format."""
    if len(choices) == 1:
        return next(iter(choices.values()))
    chain = None
    for manifest, value in choices.items():
        test = F.col("manifest") == manifest
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def _event(
    opens: Column | None = None,
    start: Column | None = None,
    name: Column | None = None,
    version: Column | None = None,
    own_name: Column | None = None,
    own_version: Column | None = None,
    emits: Column | None = None,
    line: Column | None = None,
    pos: Column | None = None,
) -> Column:
    """What one line means.

    opens: the line begins (True) or ends (False) a block; start: it is the place a block is
    reported at; name, version: it sets the current name or version ('' clears it);
    own_name, own_version: what the line itself reports; emits: how it reports, one of
    'alone' (always), 'inside' (within a block), 'named' (if a name is current) and 'end'
    (if it ends a block with a name and a version); line, pos: the place and the order within
    it, where not those of the line itself.
    """

    def text(c: Column | None) -> Column:
        return (F.lit(None) if c is None else c).cast("string")

    return F.struct(
        (F.lit(None) if opens is None else opens).cast("boolean").alias("opens"),
        (F.lit(None) if start is None else start).cast("int").alias("start"),
        text(name).alias("name"),
        text(version).alias("version"),
        text(own_name).alias("own_name"),
        text(own_version).alias("own_version"),
        text(emits).alias("emits"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        (F.lit(None) if pos is None else pos).cast("int").alias("pos"),
    )


def _line_event(manifest: str, text: Column) -> Column:
    """The dependency of a line of a line format."""
    pattern, package, version, stripped = LINE_PATTERNS[manifest]
    target = strip(text) if stripped else text
    return F.when(
        target.rlike(pattern),
        _event(
            own_name=F.regexp_extract(target, pattern, package),
            own_version=F.regexp_extract(target, pattern, version),
            emits=F.lit("alone"),
            pos=F.lit(0),
        ),
    )


def _pom_event(text: Column, line_no: Column) -> Column:
    """Multi-line <dependency> blocks; the last artifact and version in the block count."""
    artifact_tag, version_tag = r"<artifactId>(.*?)</artifactId>", r"<version>(.*?)</version>"
    has_artifact, has_version = text.rlike(artifact_tag), text.rlike(version_tag)
    return (
        F.when(
            F.contains(text, F.lit("<dependency>")),
            _event(opens=F.lit(True), start=line_no, name=F.lit(""), version=F.lit("")),
        )
        .when(F.contains(text, F.lit("</dependency>")), _event(opens=F.lit(False), emits=F.lit("end")))
        .when(
            has_artifact | has_version,
            _event(
                name=F.when(has_artifact, F.regexp_extract(text, artifact_tag, 1)),
                version=F.when(has_version, F.regexp_extract(text, version_tag, 1)),
            ),
        )
    )


def _go_event(text: Column, line_no: Column) -> Column:
    """``require`` blocks and single ``require`` lines; the module is the last path segment."""

    def event(word: Column) -> Column:
        def module(i: int) -> Column:
            return after_last(F.get(word, F.lit(i)), "/")

        return (
            F.when(F.startswith(text, F.lit("require (")), _event(opens=F.lit(True)))
            .when(F.startswith(text, F.lit(")")), _event(opens=F.lit(False)))
            .when(
                F.startswith(text, F.lit("require ")),
                F.when(
                    F.size(word) >= 3,
                    _event(own_name=module(1), own_version=F.get(word, F.lit(2)), emits=F.lit("alone")),
                ),
            )
            .when(
                F.size(word) >= 2,
                _event(own_name=module(0), own_version=F.get(word, F.lit(1)), emits=F.lit("inside")),
            )
        )

    return once(words(text), event)


def _quoted_value(text: Column) -> Column:
    return F.replace(strip(after_last(text, "=")), F.lit('"'), F.lit(""))


def _package_event(text: Column, line_no: Column) -> Column:
    """``[[package]]`` blocks with name and version lines."""
    return (
        F.when(text == "[[package]]", _event(start=line_no, name=F.lit("")))
        .when(F.startswith(text, F.lit("name = ")), _event(name=_quoted_value(text)))
        .when(
            F.startswith(text, F.lit("version = ")),
            _event(own_version=_quoted_value(text), emits=F.lit("named")),
        )
    )


def _yarn_event(text: Column, line_no: Column) -> Column:
    """A header line sets the name (empty for scoped names), a version line reports it."""
    name = F.replace(F.substring_index(text, "@", 1), F.lit('"'), F.lit(""))
    version = F.replace(strip(after_last(text, "version")), F.lit('"'), F.lit(""))
    return F.when(~F.startswith(text, F.lit("#")) & (text != ""),
        F.when(F.endswith(text, F.lit(":")), _event(name=after_last(name, "/"))).when(
            F.startswith(text, F.lit("version ")), _event(start=line_no, own_version=version, emits=F.lit("named"))
        ),
    )


BLOCK_EVENTS: dict[str, Callable[[Column, Column], Column]] = {
    "pom.xml": _pom_event,
    "go.mod": _go_event,
    "cargo.lock": _package_event,
    "poetry.lock": _package_event,
    "yarn.lock": _yarn_event,
}


VERSIONED = "MAP<STRING,STRUCT<version:STRING>>"
ENTRIES = "array<struct<name:string,version:string>>"


def _entries(versioned: Column) -> Column:
    """(name, version) per member of a JSON object, in document order."""
    pairs = F.transform(
        F.map_entries(versioned),
        lambda e: F.struct(e["key"].alias("name"), e["value"]["version"].alias("version")),
    )
    return F.coalesce(pairs, F.array().cast(ENTRIES))


def _package_lock(content: Column) -> Column:
    """The ``packages`` object where it has members, else the top-level ``dependencies``."""

    def entries(data: Column) -> Column:
        nested = F.transform(
            _entries(data["packages"]),
            lambda e: F.struct(after_last(e["name"], "node_modules/").alias("name"), e["version"].alias("version")),
        )
        return F.when(F.size(data["packages"]) > 0, nested).otherwise(_entries(data["dependencies"]))

    return once(F.from_json(content, f"packages {VERSIONED}, dependencies {VERSIONED}"), entries)


def _composer(content: Column) -> Column:
    """``packages`` entries up to the first one without a name."""

    def entries(data: Column) -> Column:
        packages = data["packages"]
        nameless = F.array_position(F.transform(packages, lambda p: p["name"].isNull()), True).cast("int")
        usable = F.when(nameless > 0, F.slice(packages, 1, nameless - 1)).otherwise(packages)
        return F.transform(
            usable, lambda p: F.struct(after_last(p["name"], "/").alias("name"), p["version"].alias("version"))
        )

    return once(F.from_json(content, f"packages {ENTRIES}"), entries)


def _pipfile(content: Column) -> Column:
    """``default`` members, then ``develop`` members, without the == of the version."""

    def entries(data: Column) -> Column:
        return F.transform(
            F.concat(_entries(data["default"]), _entries(data["develop"])),
            lambda e: F.struct(
                e["name"].alias("name"), F.replace(e["version"], F.lit("=="), F.lit("")).alias("version")
            ),
        )

    return once(F.from_json(content, f"`default` {VERSIONED}, develop {VERSIONED}"), entries)


JSON_ENTRIES: dict[str, Callable[[Column], Column]] = {
    "package-lock.json": _package_lock,
    "composer.lock": _composer,
    "pipfile.lock": _pipfile,
}


def _json_events(manifest: str, content: Column) -> Column:
    """An event for each entry; those without a name or version stand for nothing."""
    return F.filter(
        F.transform(
            JSON_ENTRIES[manifest](content),
            lambda e, i: F.when(
                (e["name"] != "") & (e["version"] != ""),
                _event(own_name=e["name"], own_version=e["version"], emits=F.lit("alone"), line=F.lit(1), pos=i),
            ),
        ),
        lambda e: e.isNotNull(),
    )


def _events(pieces: DataFrame, manifests: list[str]) -> DataFrame:
    """Rows (repo, file, line_no, the event's fields) from rows (repo, file, manifest, line_no, text)."""
    text, line_no = F.col("text"), F.col("line_no")
    choices = {}
    for name in manifests:
        if name in JSON_ENTRIES:
            choices[name] = _json_events(name, text)
        elif name in BLOCK_EVENTS:
            choices[name] = F.array_compact(F.array(BLOCK_EVENTS[name](strip(text), line_no)))
        else:
            choices[name] = F.array_compact(F.array(_line_event(name, text)))
    return pieces.select("repo", "file", "line_no", F.inline(_by_manifest(choices)))


def _pieces(files: DataFrame) -> DataFrame:
    """Lines of files (repo, path, manifest, content); a JSON manifest is one piece."""
    whole = F.col("manifest").isin(list(JSON_ENTRIES))
    pieces = F.when(whole, F.array("content")).otherwise(split_lines(F.col("content")))
    return files.select(
        "repo", F.col("path").alias("file"), "manifest", F.posexplode(pieces).alias("at", "text")
    ).withColumn("line_no", F.col("at") + 1)


def _carried(events: DataFrame) -> DataFrame:
    """Events that report something, with the state the events before them left.

    Texts were cut to names and versions before this shuffle; the window sorts the events of one file at a time.
    """
    in_file = Window.partitionBy("repo", "file").orderBy("line_no", "pos")
    so_far = in_file.rowsBetween(Window.unboundedPreceding, 0)
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    state = events.select(
        "repo",
        "file",
        "line_no",
        "own_name",
        "own_version",
        "emits",
        "line",
        "pos",
        F.last("opens", ignorenulls=True).over(before).alias("inside"),
        F.last("start", ignorenulls=True).over(so_far).alias("start"),
        F.last("name", ignorenulls=True).over(so_far).alias("name"),
        F.last("version", ignorenulls=True).over(so_far).alias("version"),
    )
    emits, named = F.col("emits"), F.coalesce(F.col("name"), F.lit("")) != ""
    inside = F.coalesce(F.col("inside"), F.lit(False))
    return state.filter(
        (emits == "alone")
        | ((emits == "inside") & inside)
        | ((emits == "named") & named)
        | ((emits == "end") & inside & named & (F.coalesce(F.col("version"), F.lit("")) != ""))
    )


def line_deps(pieces: DataFrame, manifests: list[str]) -> DataFrame:
    """Dependencies from rows (repo, file, manifest, line_no, text) of the given manifests."""
    found = _events(pieces, manifests)
    if any(name in BLOCK_EVENTS for name in manifests):
        found = _carried(found)
    place = F.when(F.col("emits").isin("alone", "inside"), F.col("line_no")).otherwise(F.coalesce("start", F.lit(1)))
    return found.select(
        "repo",
        "file",
        F.coalesce("line", place).cast("int").alias("line"),
        F.lower(F.coalesce("own_name", "name")).alias("package"),
        F.coalesce("own_version", "version").alias("version"),
        F.coalesce("pos", "line_no").cast("int").alias("pos"),
    )


def extract_deps(files: DataFrame, manifests: list[str] | None = None) -> DataFrame:
    """Dependencies from the manifests of a corpus (all kinds, or the given ones), in one scan of it.

    The name of a manifest file counts in any case.
    """
    wanted = manifests or [*LINE_PATTERNS, *BLOCK_EVENTS, *JSON_ENTRIES]
    chosen = (
        select_scan_sets(files)
        .filter("for_dependencies")
        .select("repo", "path", "content", F.lower(base_name(F.col("path"))).alias("manifest"))
        .filter(F.col("manifest").isin(wanted))
    )
    return line_deps(_pieces(chosen), wanted)
