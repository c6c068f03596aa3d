"""Log files: reading lines and turning them into entries."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip
from ..functions.timestamps import parse_ts
from ..functions.values import blank_to_null
from ..schema import POSITION_COLUMNS, UNKNOWN_LEVEL, conform
from . import documents as docs

# Keys that may hold the message, best first, and the keys of the ids.
MESSAGE_KEYS = ("message", "msg", "log", "text", "body")
TRACE_KEYS = ("trace_id", "traceId")
SPAN_KEYS = ("span_id", "spanId")


@dataclass(frozen=True)
class LineOptions:
    timestamp_field: str = "timestamp"
    level_field: str = "level"
    service_field: str = "service"
    host_field: str | None = None
    message_field: str | None = None

    def envelope_keys(self) -> list[str]:
        named = [
            self.timestamp_field,
            self.level_field,
            self.service_field,
            self.host_field,
            self.message_field,
        ]
        return [k for k in (*named, *TRACE_KEYS, *SPAN_KEYS) if k]


# Path patterns: `**` spans folders, `*` and `?` stay in one, `[...]` is a set (`!` or `^` first: all but it), `{a,b}` a choice.
_GLOB = re.compile(r"\*\*/|\*\*|\*|\?|\[[!^]?\]?[^\]]*\]|\{[^{}]*\}|.", re.S)


def path_regex(pattern: str) -> str:
    """Regex, for a whole path, of a path pattern."""
    plain = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}

    def part(piece: str) -> str:
        if piece in plain:
            return plain[piece]
        if len(piece) > 1 and piece[0] == "[":
            inner = re.sub(r"([\\\[\]&~])", r"\\\1", re.sub("^[!^]", "", piece[1:-1]))
            return f"[^/{inner}]" if piece[1] in "!^" else f"[{inner}]"
        if len(piece) > 1:
            return f"(?:{'|'.join(path_regex(choice) for choice in piece[1:-1].split(','))})"
        return re.escape(piece)

    return "".join(part(piece) for piece in _GLOB.findall(pattern.rstrip("/")))


def decoded_path(path: Column) -> Column:
    """A file's path as text: file listings give it as an URI. A plus sign stands for itself there."""
    return _short(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def _short(path: Column) -> Column:
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")


def qualified_path(spark: SparkSession, pattern: str) -> str:
    """A pattern with the file system it belongs to, as file listings name it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub("^([A-Za-z][A-Za-z0-9+.-]*):///", r"\1:/", system.makeQualified(path).toString())


def _matches(spark: SparkSession, path: Column, pattern: str) -> Column:
    """Whether a pattern stands for the file; a plain folder stands for the files in it."""
    regex = path_regex(qualified_path(spark, pattern))
    return path.rlike(f"^(?:{regex})(?:/[^/]*)?$")


def _root(pattern: str) -> tuple[str, bool]:
    """What to list for a pattern, and whether with all folders below."""
    if "**" not in pattern:
        return pattern, False
    return pattern[: pattern.index("**")].rpartition("/")[0] or ("/" if pattern.startswith("/") else "."), True


def _patterns(paths) -> list[str]:
    return list(dict.fromkeys([paths] if isinstance(paths, str) else paths))


def _own_files(spark: SparkSession, files: DataFrame, patterns: list[str], i: int) -> DataFrame:
    """The rows whose file_path the i-th pattern stands for, and none before it."""
    path = decoded_path(F.col("file_path"))
    if "**" in patterns[i]:
        files = files.where(path.rlike(f"^(?:{path_regex(qualified_path(spark, patterns[i]))})$"))
    for earlier in patterns[:i]:
        files = files.where(~_matches(spark, path, earlier))
    return files


def _raw_lines(reader, pattern: str) -> DataFrame | None:
    """Raw lines of all files to list for a pattern, batch or stream; None if there is no such file."""
    root, spans = _root(pattern)
    try:
        lines = reader.option("recursiveFileLookup", spans).text(root)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def with_positions(lines: DataFrame, source: str) -> DataFrame:
    """Raw lines (value, file_path, block_start), stripped, without blank ones, with source and `line_pos`."""
    return (
        lines.withColumn("line_pos", F.monotonically_increasing_id())
        .withColumn("value", strip(F.make_valid_utf8("value")))
        .where(F.col("value") != "")
        .select(F.lit(source).alias("source"), *POSITION_COLUMNS, "value")
    )


def read_log_lines(spark: SparkSession, paths, source: str) -> DataFrame:
    """Stripped, non-blank lines of all files matching `paths`, with their position.

    Columns: source, file_path, block_start, line_pos, value. Within one block of a file
    `line_pos` rises with the line, so (file_path, block_start, line_pos) is the order of the
    files' text. A file matched by several patterns is read for the first one only. Files that
    cannot be read and patterns without a file give no rows.
    """
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    patterns, lines = _patterns(paths), None
    for i, pattern in enumerate(patterns):
        found = _raw_lines(reader, pattern)
        if found is not None:
            found = _own_files(spark, found, patterns, i)
            lines = found if lines is None else lines.unionByName(found)
    if lines is None:
        lines = spark.createDataFrame([], "value string, file_path string, block_start bigint")
    return with_positions(lines, source)


def stream_raw_lines(spark: SparkSession, paths, files_per_batch: int | None = None) -> DataFrame:
    """Raw lines (value, file_path, block_start) of the files matching `paths`, as a stream of files.

    A file is read once, when it is first seen: move finished files into the folder, as what is added to one later
    is not read. Every pattern's folder must exist. Patterns are as in `read_log_lines`.
    """
    reader = spark.readStream.option("ignoreMissingFiles", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    patterns = _patterns(paths)
    streams = [_own_files(spark, _raw_lines(reader, pattern), patterns, i) for i, pattern in enumerate(patterns)]
    return reduce(DataFrame.unionByName, streams)


def log_files(spark: SparkSession, paths, source: str) -> DataFrame:
    """(source, file_path, readable) of all files matching `paths` that have bytes, each once.

    One that gives no line at all, not even a blank one, could not be read. Only names are listed; the lines are
    counted inside the tasks. Files without any bytes are not listed, as no scan opens them.
    """
    patterns = _patterns(paths)
    files = spark.createDataFrame([], "file_path string, lines bigint")
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    for i, pattern in enumerate(patterns):
        found = _raw_lines(reader, pattern)
        if found is None:
            continue
        root, spans = _root(pattern)
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", spans).load(root)
        listed = _own_files(spark, listing.select(F.col("_metadata.file_path").alias("file_path")), patterns, i)
        counts = found.groupBy("file_path").agg(F.count("*").alias("lines"))
        files = files.unionByName(listed.join(counts, "file_path", "left"))
    readable = F.coalesce(F.max("lines"), F.lit(0)) > 0
    return files.groupBy("file_path").agg(readable.alias("readable")).select(
        F.lit(source).alias("source"), "file_path", "readable"
    )


def json_document(value: Column) -> Column:
    """Document of a line that is a JSON object, else null."""
    return docs.document(docs.json_object(value))


def compile_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """Java form of a regex with named groups, and the number of each name.

    Group names are dropped because Java knows neither `(?P<` nor `_` in a name. Sets lose Java's own meanings of `[` and
    `&&` in them, `\\Z` and `{,n}` get their Java spelling. Refused, as Java has nothing like them: conditions
    `(?(1)...)`, comments `(?#...)`, named characters `\\N{...}` and the flags a and L.
    """
    names = dict(re.compile(pattern).groupindex)
    token = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<\w+>|\(\?P=(\w+)\)|\{,\d+\}|\(\?(?:\(|#|[a-zA-Z]*[aL])", re.S)

    def plain(found):
        text = found.group()
        if text.startswith("(?P<"):
            return "("
        if found.group(1):
            return "\\" + str(names[found.group(1)])
        if text.startswith("(?") or text == "\\N":
            raise ValueError(f"{text} is not available in patterns")
        if text.startswith("["):
            first = 2 if text.startswith("[^") else 1
            inner = re.sub(r"\\.|^\]|\[|&&", lambda m: {"]": "\\]", "[": "\\[", "&&": "&\\&"}.get(m[0], m[0]), text[first:-1])
            return text[:first] + inner + "]"
        return {"\\Z": "\\z"}.get(text, text.replace("{,", "{0,") if text.startswith("{,") else text)

    return token.sub(plain, pattern), names


def regex_document(value: Column, pattern: str) -> Column:
    """Document of the named groups if the regex matches at the start of the line, else null.

    Letters, digits and spaces are those of all scripts, as `(?U)` says to Java.
    A group that took no part in the match, or matched nothing, counts as an absent key.
    """
    java, names = compile_pattern(pattern)
    whole = f"(?U)^(?:{java})"
    pairs = []
    for name, number in names.items():
        pairs += [F.lit(name), blank_to_null(F.regexp_extract(value, whole, number))]
    groups = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.when(value.rlike(whole), docs.text_document(groups))


def to_entry(df: DataFrame, opts: LineOptions = LineOptions()) -> DataFrame:
    """Entries from the columns `doc` and `value`; a null `doc` is a plain line.

    A plain line keeps its text as message, has level UNKNOWN and no time. A JSON null counts as
    an absent key.
    """
    doc, line = F.col("doc"), F.col("value")
    first_keys = ([opts.message_field] if opts.message_field else []) + list(MESSAGE_KEYS)
    whole = F.when(F.col("is_json_line"), line).otherwise(F.to_json(docs.fields_of(doc)))
    message = F.coalesce(*[docs.text_of(doc, k) for k in first_keys], whole, line)
    service = docs.truthy(doc, opts.service_field)
    host = docs.truthy(doc, opts.host_field) if opts.host_field else F.lit(None).cast("string")
    ts_raw = docs.text_of(doc, opts.timestamp_field)
    extra = docs.without(doc, opts.envelope_keys())
    named = df.select(
        "*",
        F.col("line_pos").alias("seq") if "line_pos" in df.columns else F.lit(None).alias("seq"),
        ts_raw.alias("ts_raw"),
        parse_ts(ts_raw).alias("ts"),
        F.coalesce(F.upper(docs.text_of(doc, opts.level_field)), F.lit(UNKNOWN_LEVEL)).alias("level"),
        message.alias("message"),
        service.alias("service"),
        host.alias("host"),
        docs.truthy(doc, *TRACE_KEYS).alias("trace_id"),
        docs.truthy(doc, *SPAN_KEYS).alias("span_id"),
        extra.alias("extra"),
        F.when(doc.isNotNull(), line).alias("raw"),
    )
    empty = F.create_map().cast("map<string,string>")
    return conform(
        named.withColumn("fields", F.coalesce(docs.fields_of(F.col("extra")), empty)).withColumn(
            "search_text",
            docs.search_text(F.col("message"), F.col("service"), F.col("host"), F.col("extra")),
        )
    )


def _with_document(lines: DataFrame, doc: Column) -> DataFrame:
    """Lines that have a document, in the column `doc`.

    Exploding an array of none or one keeps the parsing out of a filter, which would be pushed
    below the projection and parse every line a second time.
    """
    return lines.select("*", F.explode(F.array_compact(F.array(doc))).alias("doc"))


def parse_json_lines(lines: DataFrame, opts: LineOptions = LineOptions()) -> DataFrame:
    """Entries of the lines that are JSON objects."""
    found = _with_document(lines, json_document(F.col("value")))
    return to_entry(found.withColumn("is_json_line", F.lit(True)), opts)


def parse_regex_lines(
    lines: DataFrame, pattern: str, opts: LineOptions = LineOptions()
) -> DataFrame:
    """Entries of the lines that the named-group regex matches at their start."""
    found = _with_document(lines, regex_document(F.col("value"), pattern))
    return to_entry(found.withColumn("is_json_line", F.lit(False)), opts)


def plain_lines(lines: DataFrame) -> DataFrame:
    """Every line as an entry of its own text, with no level and no time."""
    doc = F.lit(None).cast("map<string,struct<text:string,is_text:boolean>>")
    return to_entry(lines.withColumn("doc", doc).withColumn("is_json_line", F.lit(False)))


def parse_lines(
    lines: DataFrame,
    json: bool = True,
    pattern: str | None = None,
    opts: LineOptions = LineOptions(),
) -> DataFrame:
    """Entries of all lines: JSON object first, then the regex, then plain text."""
    value = F.col("value")
    doc = F.lit(None).cast("map<string,struct<text:string,is_text:boolean>>")
    parsed = lines.withColumn("doc", json_document(value) if json else doc)
    parsed = parsed.withColumn("is_json_line", F.col("doc").isNotNull())
    if pattern:
        parsed = parsed.withColumn("doc", F.coalesce("doc", regex_document(value, pattern)))
    return to_entry(parsed, opts)
