"""Reading session logs and tables, and keeping results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.columns import message_marker
from ..operators.ordered import between_join, ranked
from ..operators.trials import reshape_triggers

_NUMBER = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"


def _lines(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Lines of all files with their file and ``line``, by which a file's lines are ordered; files of any size are split.

    In ``bundled`` files, as :func:`write_logs` makes them, ``file`` is the session's name that stands before a line's first tab.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    if bundled:
        rows = rows.withColumn("__p", F.split("text", "\t", 2)).select(F.col("__p")[0].alias("file"), "block", F.get("__p", F.lit(1)).alias("text"))
    return rows.select("file", F.struct("block", F.monotonically_increasing_id().alias("row")).alias("line"), "text")


def write_logs(lines: DataFrame, session: str, order: str, text: str) -> str:
    """The path of a new folder of session logs, many to a file: each line follows its session's name and a tab.

    A session lies in one file, in order. A folder or a file for each session
    would cost the driver, which lists and renames them one by one, more than
    the rows; there are as many files here as tasks.
    """
    rows = lines.repartition(session).sortWithinPartitions(session, order)
    return written(rows.select(F.concat_ws("\t", F.col(session).cast("string"), text).alias("value")), "session-logs", "text")


def read_positions(spark: SparkSession, path: str, *, bundled: bool = False) -> DataFrame:
    """Position rows (file, seq, marker, dt, x, y, dir) of session logs.

    Data lines begin with a digit; of six columns the first is dropped. Of
    ``bundled`` logs (:func:`write_logs`) ``file`` is the session's name.
    """
    rows = _lines(spark, path, bundled).where(F.col("text").rlike(r"^\s*\d"))
    parts = F.split(F.trim("text"), r"\s+")
    rows = rows.select("file", "line", F.when(F.size(parts) >= 6, F.slice(parts, 2, 5)).otherwise(parts).alias("p"))
    rows = ranked(rows, ["file"], "line", "seq", bucket=F.col("line.block"))  # a bucket for each piece of a file
    return rows.select("file", "seq", *[F.col("p")[k].cast("double").alias(n) for k, n in enumerate(("marker", "dt", "x", "y", "dir"))])


def read_headers(spark: SparkSession, path: str, *, bundled: bool = False) -> DataFrame:
    """``key: value`` lines of session logs as a map for each file; a key's last value counts."""
    rows = _lines(spark, path, bundled).where(~F.col("text").rlike(r"^\s*\d") & F.col("text").contains(":"))
    pair = F.split("text", ":", 2)
    kept = rows.select("file", "line", F.trim(pair[0]).alias("k"), pair[1].alias("v")).groupBy("file", "k").agg(F.max_by("v", "line").alias("v"))
    return kept.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("header"))


def read_posters(spark: SparkSession, path: str, *, bundled: bool = False) -> DataFrame:
    """Posters of session logs: (file, maze, poster, name, x, y, z).

    Old logs list them in one ``PosterLocations`` line; new ones have a ``name``
    line for each, and its position in the line after. ``maze`` is the last
    ``MazeName`` before.
    """
    rows = _lines(spark, path, bundled).where(~F.col("text").rlike(r"^\s*\d") & F.col("text").contains(":"))
    pair = F.split("text", ":", 2)
    w = Window.partitionBy("file").orderBy("line")  # a file's header lines
    rows = rows.select("file", "line", F.trim(pair[0]).alias("k"), F.trim(pair[1]).alias("v"))
    maze = F.last(F.when(F.col("k") == "MazeName", F.col("v")), ignorenulls=True).over(w)
    rows = rows.withColumns({"maze": maze, "after": F.lead("v").over(w)})
    old = rows.where("k = 'PosterLocations'").select("file", "maze", F.explode(posters(F.col("v"))).alias("p"))
    old = old.select("file", "maze", F.col("p.poster").alias("poster"), F.lit(None).cast("string").alias("name"), "p.x", "p.y", "p.z")
    new = rows.where("k = 'name'").select("file", "maze", F.lit(None).cast("int").alias("poster"), F.col("v").alias("name"), triple(F.col("after")).alias("p"))
    return old.unionByName(new.select("file", "maze", "poster", "name", "p.x", "p.y", "p.z"))


def discover(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files under ``root``, at any depth, whose names match a glob pattern: (path, length)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select("path", "length")


def posters(text: Column) -> Column:
    """Posters named in a text: array of struct(poster, x, y, z) for each ``P<n>(x,y,z)``."""
    pattern = rf"P(\d+)\(\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\)"
    every = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, 5)]
    return F.transform(
        F.arrays_zip(*[e.alias(n) for e, n in zip(every, "nxyz", strict=True)]),
        lambda s: F.struct(s["n"].cast("int").alias("poster"), s["x"].cast("double").alias("x"), s["y"].cast("double").alias("y"), s["z"].cast("double").alias("z")),
    )


def triple(text: Column) -> Column:
    """``(x, y, z)`` as struct(x, y, z)."""
    pattern = rf"\(\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\)"
    return F.struct(*[F.regexp_extract(text, pattern, k).try_cast("double").alias(n) for k, n in enumerate("xyz", 1)])


def poster_image(mazes: DataFrame, images: DataFrame, name: str = "maze") -> DataFrame:
    """The first image by name whose file name holds the last word of a maze's name, or null; ``images`` is a small table (image)."""
    word = F.lower(F.element_at(F.split(F.trim(F.col(name)), r"\s+"), -1))
    every = images.agg(F.array_sort(F.collect_set("image"))).scalar()  # a maze meets all images inside its row
    found = F.get(F.filter("__every", lambda i: F.contains(F.lower(i), F.col("__word"))), F.lit(0))
    return mazes.withColumns({"__every": every, "__word": word}).withColumn("image", found).drop("__every", "__word")


def raytrace_columns(df: DataFrame) -> DataFrame:
    """Traced gaze from a table of at least twelve columns: time, object, position, angle (radians), gaze; y and z swapped, rows without gaze left out."""
    num = lambda k: F.col(df.columns[k - 1]).try_cast("double")
    return df.select(
        num(2).alias("t"), F.col(df.columns[2]).alias("object"), num(6).alias("px"), num(8).alias("py"), num(7).alias("pz"),
        F.radians(num(9)).alias("angle"), num(10).alias("gx"), num(12).alias("gy"), num(11).alias("gz"),
    ).dropna(subset=["gx", "gy", "gz"])


def read_raytrace(spark: SparkSession, path: str) -> DataFrame:
    """:func:`raytrace_columns` of CSV files without header."""
    return raytrace_columns(spark.read.csv(path, schema=", ".join(f"c{k} string" for k in range(1, 13)), header=False))


def align_clock(gaze: DataFrame, trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaze times moved so that the first falls on the first trial's start."""
    zero = gaze.groupBy(*keys).agg(F.min("t").alias("__g")).join(trials.groupBy(*keys).agg(F.min("t1").alias("__t")), list(keys))
    return gaze.join(zero, list(keys)).withColumn("t", F.col("t") - F.col("__g") + F.col("__t")).drop("__g", "__t")


def gaze_by_trial(traced: DataFrame, trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Traced gaze (keys, t, gx, gy, gz) cut by trial: (keys, trial, t, gx, gy, gz, fixated), t in seconds from the trial's first sample.

    The trials run on another clock, which is set so that its first trial begins
    with the first sample (:func:`align_clock` the other way round). Samples in
    [t1, t3] belong to a trial, those without gaze too; none counts as fixated,
    as the table does not say. Times are in ms.
    """
    keys = list(keys)
    shift = traced.groupBy(*keys).agg(F.min("t").alias("__g")).join(trials.groupBy(*keys).agg(F.min("t1").alias("__t")), keys)
    set_ = trials.join(shift, keys).select(*keys, "trial", *[(F.col(c) - F.col("__t") + F.col("__g")).alias(f"__{c}") for c in ("t1", "t3")])
    cut = between_join(traced, set_, keys, "t", "__t1", "__t3").drop("__t1", "__t3")
    first = cut.groupBy(*keys, "trial").agg(F.min("t").alias("__first"))
    zeroed = cut.join(first, [*keys, "trial"]).withColumn("t", (F.col("t") - F.col("__first")) / 1000)
    return zeroed.select(*keys, "trial", "t", "gx", "gy", "gz", F.lit(False).alias("fixated"))


def load_sorting(spark: SparkSession, root: str, **level) -> dict[str, DataFrame]:
    """A sort and its recording at a level: ``templates`` (unit, channel, pt, v), ``firings`` (unit, idx) and ``samples`` (channel, idx, v).

    Only firings of units that have a template are given, and templates of
    channels that were recorded.
    """
    templates, firings, samples = (load(spark, root, kind, **level) for kind in ("templates", "firings", "samples"))
    levels = [c for c in ("day", "session", "array") if all(c in t.columns for t in (templates, firings, samples))]
    return {
        "templates": templates.join(samples.select(*levels, "channel").distinct(), [*levels, "channel"], "left_semi"),
        "firings": firings.join(templates.select(*levels, "unit").distinct(), [*levels, "unit"], "left_semi"),
        "samples": samples,
    }


def read_spikes(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    """Spike times in ms, one a line; no rows if there is no such file.

    Where a file holds many cells, ``keys`` (``user_id long``, say) are the columns before the time.
    """
    schema = f"{keys}, t_ms double" if keys else "t_ms double"
    try:
        return spark.read.schema(schema).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parse_cell(name: Column) -> Column:
    """``20180706ch12c1`` as struct(day, channel, cell): ``20180706``, ``012``, ``01``."""
    part = lambda k: F.regexp_extract(name, r"^(\d{8})ch(\d+)c(\d+)$", k)
    return F.struct(part(1).alias("day"), F.lpad(part(2), 3, "0").alias("channel"), F.lpad(part(3), 2, "0").alias("cell"))


def write_levels(df: DataFrame, path: str, levels: Sequence[str] = ("day", "session", "array", "channel", "cell"), *, within: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet in folders by those levels that the table has; ``mode`` append adds to what is there.

    Levels ``within`` have too many values for folders, which the driver lists and
    renames one by one: they stay columns, by which a folder's files are sorted, so
    that :func:`load` skips row groups of other values.
    """
    folders, inside = ([c for c in levels if c in df.columns and (c in within) == own] for own in (False, True))
    rows = df.sortWithinPartitions(*folders, *inside) if inside else df
    rows.write.mode(mode).partitionBy(*folders).parquet(path)


def load(spark: SparkSession, root: str, kind: str, **filters: str) -> DataFrame:
    """One kind of table under ``root``, cut to the given levels; partitions are pruned."""
    df = spark.read.parquet(f"{root}/{kind}")
    for name, value in filters.items():
        df = df.where(F.col(name) == value)
    return df


def materialize(spark: SparkSession, df: DataFrame, path: str, *, redo: bool = False) -> DataFrame:
    """The table at ``path``; computed and written first if it is not there, or on ``redo``."""
    if not redo:
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_own: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which driver and executors share.

    Where the session has none and runs in one process, it lies in a temporary folder.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        told = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{told.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, form: str, by: Sequence[str] = ()) -> str:
    """The path of a new folder of files in this format, parted by ``by``."""
    path = scratch(df.sparkSession, label)
    writer = df.write.format(form)
    (writer.partitionBy(*by) if by else writer).save(path)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Operators that deal a stream into buckets read it twice, once for a few
    columns; where one follows another, what the first gives is kept, or all
    before it would be computed again each time. A lost executor costs a re-read.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label, "parquet"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`written` made and that a later one has replaced."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def gaze_coordinates(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Screen limits from each session's first GAZE_COORDS message (keys, x0, y0, x1, y1)."""
    first = events.where(F.col("message").startswith("GAZE_COORDS")).groupBy(*keys).agg(F.min_by("message", "seq").alias("m"))
    part = F.split(F.trim(F.regexp_extract("m", r"GAZE_COORDS\s+(.*)$", 1)), r"\s+")
    return first.select(*keys, *[part[k].cast("double").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


def recorded_eyes(gaze: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Eyes whose least gaze value is not the mark of a lost signal."""
    return gaze.groupBy(*keys, "eye").agg(F.min("gx").alias("__m")).where("__m > -32768").drop("__m")


def extract_eye(events: DataFrame, samples: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """What a recording of eye events (keys, seq, eventtype, message, sttime, entime, gstx, gsty, genx, geny) and samples (keys, eye, t, gx, gy) holds.

    ``screen``: limits; ``eyes``: recorded ones; ``fixations`` and ``saccades``
    with starts, ends and, for saccades, both points; ``triggers``: trials from
    messages; ``gaze``: samples. Rows count from the bottom of the screen.
    """
    keys = list(keys)
    messages = events.where("eventtype = 'messageevent'")
    screen = gaze_coordinates(messages, keys)
    height = screen.select(*keys, F.col("y1").alias("__h"))
    saccades = events.where("eventtype = 'endsacc'").join(height, keys, "left")
    markers = messages.withColumn("marker", message_marker(F.col("message"))).where("marker is not null")
    return {
        "screen": screen,
        "eyes": recorded_eyes(samples, keys),
        "fixations": events.where("eventtype = 'endfix'").select(*keys, F.col("sttime").alias("t_start"), F.col("entime").alias("t_end")),
        "saccades": saccades.select(*keys, F.col("sttime").alias("t_start"), F.col("entime").alias("t_end"), F.col("gstx").alias("x0"), (F.col("__h") - F.col("gsty")).alias("y0"), F.col("genx").alias("x1"), (F.col("__h") - F.col("geny")).alias("y1")),
        "triggers": reshape_triggers(markers, keys, time="sttime"),
        "gaze": samples.join(height, keys, "left").withColumn("gy", F.col("__h") - F.col("gy")).drop("__h"),
    }
