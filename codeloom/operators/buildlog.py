"""Mining compiler calls recorded as ``record_id, cwd, compiler, argv`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims

# Options that take the next argument, and joined option forms.
VALUE_FLAGS = ["-I", "-D", "-U", "-include"]
JOINED_FLAGS = "^(?:-I|-D|-U|-std=)"

_ITEM = "array<struct<arg_no:int,role:string,arg:string>>"


def classified_args(argv: Column) -> Column:
    """Arguments with a role: ``source``, ``flag`` or ``value`` of a flag.

    One fold, because an argument taken as a value is nothing else.
    """
    zero = F.expr(f"named_struct('n', 0, 'takes', false, 'out', cast(array() as {_ITEM}))")

    def step(s: Column, arg: Column) -> Column:
        source = ~s.takes & arg.endswith(".c")
        takes = ~s.takes & ~source & arg.isin(VALUE_FLAGS)
        role = (
            F.when(s.takes, "value")
            .when(source, "source")
            .when(takes | arg.rlike(JOINED_FLAGS), "flag")
        )
        item = F.struct((s.n + 1).alias("arg_no"), role.alias("role"), arg.alias("arg"))
        return F.struct(
            (s.n + 1).alias("n"),
            takes.alias("takes"),
            F.when(role.isNotNull(), F.array_append(s.out, item)).otherwise(s.out).alias("out"),
        )

    return F.aggregate(argv, zero, step, lambda s: s.out)


def _of_role(argv: Column, *roles: str) -> Column:
    return F.filter(classified_args(argv), lambda a: a.role.isin(*roles))


def compile_sources(records: DataFrame) -> DataFrame:
    return records.select(
        "record_id", "cwd", F.explode(_of_role(F.col("argv"), "source")).alias("a")
    ).select("record_id", "cwd", "a.arg_no", F.col("a.arg").alias("source"))


def preprocessor_flags(records: DataFrame) -> DataFrame:
    """Flags and their values in command order, numbered within the record."""
    return records.select(
        "record_id", F.posexplode(_of_role(F.col("argv"), "flag", "value")).alias("pos", "a")
    ).select("record_id", (F.col("pos") + 1).alias("flag_no"), F.col("a.arg").alias("flag"))


def compile_only(argv: Column) -> Column:
    return F.array_contains(argv, "-c")


def absolute_source(cwd: Column, source: Column) -> Column:
    return F.when(source.startswith("/"), source).otherwise(F.concat_ws("/", cwd, source))


def path_segments(path: Column) -> Column:
    """Segments of an absolute path with ``.`` and ``..`` resolved."""

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg.isin("", "."), acc)
            .when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.array_append(acc, seg))
        )

    return F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step)


def preprocessed_path(source: Column, project_root: str, out_root: str) -> Column:
    """Where the preprocessed text of an absolute source goes.

    The path relative to the project, without its ``..`` steps, under the
    output folder; steps up vanish, so what counts is the common prefix.
    """
    root = [s for s in project_root.split("/") if s]
    segments = path_segments(source)
    shared = F.lit(0)
    for n in range(len(root), 0, -1):
        prefix = F.array(*[F.lit(s) for s in root[:n]])
        shared = F.when((shared == 0) & (F.slice(segments, 1, n) == prefix), n).otherwise(shared)
    tail = F.slice(segments, shared + 1, F.size(segments))
    return F.concat(F.lit(out_root.rstrip("/") + "/"), F.array_join(tail, "/"), F.lit(".i"))


def metadata_path(output: Column) -> Column:
    return F.regexp_replace(output, r"\.i$", ".meta.json")


def compiler_family(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Adds ``family`` by the wrapper's base name; unknown names are gcc."""
    return (
        records.withColumn("compiler", F.regexp_extract("compiler", r"([^/]*)$", 1))
        .join(F.broadcast(dims.compiler_families(spark)), "compiler", "left")
        .withColumn("family", F.coalesce("family", F.lit(dims.DEFAULT_COMPILER)))
    )
