"""Source files as documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = (".cpp", ".cc", ".cxx", ".h", ".hpp", ".java", ".py", ".js", ".ts", ".c")
LANGUAGES = {"C++": (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp"), "Python": (".py", ".pyw"), "Java": (".java",), "JavaScript": (".js", ".jsx", ".ts", ".tsx")}
LEXER_OF = {"C++": "cpp", "Python": "python", "Java": "java", "JavaScript": "javascript"}


def has_supported_extension(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(cpp|cc|cxx|h|hpp|java|py|js|ts|c)\z")


def is_ignored_directory(name: Column) -> Column:
    return name.rlike(r"^(\..*|build|out|bin|cmake-build.*)\z")


def in_ignored_directory(display: Column) -> Column:
    """Whether a directory of a relative path, not the file itself, is ignored."""
    parts = F.split(display, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), is_ignored_directory)


def detect_language(name: Column) -> Column:
    """By the extension of the last path segment; a name that only is an extension has none."""
    extension = F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)\z", 1))
    out = F.lit("Unknown")
    for language, extensions in LANGUAGES.items():
        out = F.when(extension.isin(*extensions), language).otherwise(out)
    return out


def language_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, e) for k, v in LANGUAGES.items() for e in v], "language string, extension string")


def discover(spark: SparkSession, root: str, deduplicate: bool = True) -> tuple[DataFrame, list[str]]:
    """(files: doc_id, display, path, language, content; warnings) under a directory, or one file.

    Ids follow the bytewise order of the path below the root. Hidden, build and
    output directories are not entered; a path that leads to a file seen before
    is left out, the first by order staying. A missing root or an unsupported
    single file is an error; unreadable files are skipped with a warning.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    warnings: list[str] = []
    found: list[tuple[str, str]] = []
    if os.path.isfile(root):
        if not os.path.basename(root).lower().endswith(EXTENSIONS):
            raise ValueError(f"unsupported file {root}")
        found.append((os.path.basename(root), root))
    else:
        for at, directories, names in os.walk(root):
            directories[:] = [d for d in directories if not (d.startswith((".", "cmake-build")) or d in ("build", "out", "bin"))]
            for name in names:
                path = os.path.join(at, name)
                if name.lower().endswith(EXTENSIONS) and os.path.isfile(path):
                    found.append((os.path.relpath(path, root), path))
    kept, seen = [], set()
    for display, path in sorted(found, key=lambda f: f[0].encode()):
        real = os.path.realpath(path)
        if deduplicate and real in seen:
            continue
        seen.add(real)
        if os.access(real, os.R_OK):
            kept.append((len(kept), display, real))
        else:
            warnings.append(f"skipped '{display}': could not open file")
    schema = "doc_id bigint, display string, path string, language string, content binary"
    if not kept:
        return spark.createDataFrame([], schema), warnings
    listing = spark.createDataFrame(kept, "doc_id bigint, display string, real string").repartition(min(len(kept), 4 * spark.sparkContext.defaultParallelism))
    # a file is read where its row lies, by its path as it is: a reader of file tables would glob and encode it
    read = listing.mapInArrow(_contents, "doc_id bigint, display string, path string, content binary, error string").persist()
    warnings += [f"skipped '{r.display}': {r.error}" for r in read.where("error is not null").select("display", "error").orderBy("display").collect()]
    found_ = read.where("error is null").withColumn("doc_id", F.col("doc_id"))
    if any(w.endswith("could not read file") for w in warnings):
        found_ = found_.withColumn("doc_id", (F.row_number().over(Window.orderBy("doc_id")) - 1).cast("bigint"))
    return found_.select("doc_id", "display", "path", detect_language(F.col("display")).alias("language"), "content"), warnings


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            content, error = None, None
            try:
                with open(row.column(2)[0].as_py(), "rb") as f:
                    content = f.read()
            except OSError:
                error = "could not read file"
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["doc_id", "display", "path", "content", "error"])


def uploads(files: DataFrame, least: int = 2, most: int = 100, max_bytes: int = 1 << 20) -> DataFrame:
    """(name, content) of an upload: names made safe, the last of equal names staying; a wrong number, size or type is an error."""
    allowed = r"\.(cpp|cc|cxx|h|hpp|c|py|pyw|java|js|jsx|ts|tsx)\z"
    bad = files.agg(F.count("*").alias("n"), F.count_if(F.length("content") > max_bytes).alias("big"), F.count_if(~F.lower("name").rlike(allowed)).alias("other")).first()
    if not least <= bad.n <= most or bad.big or bad.other:
        raise ValueError(f"{bad.n} files, {bad.big} too large, {bad.other} of other types")
    safe = files.select(F.regexp_replace("name", r"[^a-zA-Z0-9._-]", "_").alias("name"), "content", F.monotonically_increasing_id().alias("_at"))
    latest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("_at")))
    return safe.withColumn("_n", latest).where("_n = 1").select("name", "content")


def synthetic(spark: SparkSession, files: int, lines: int, seed: int = 42, clone_fraction: float = 0.2, kept: float = 0.8) -> DataFrame:
    """(doc_id, text): made-up code; the last ``clone_fraction`` of the files repeat the first ``kept`` of the lines of an earlier one."""
    originals = max(1, files - int(files * clone_fraction))
    shapes = ["int v{a} = {b};", "v{a} = v{c} + {b};", "if (v{a} > {b}) {{ v{c}++; }}", "for (int i = 0; i < {b}; ++i) {{ f{a}(i); }}", "return g{a}(v{c}, {b});", "// step {b}", 'print("{b}", v{a});']
    rows = spark.range(files).select("id", F.when((F.col("id") < originals), F.col("id")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(originals))).alias("origin"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"))
    owner = F.when(F.col("line") < int(lines * kept), F.col("origin")).otherwise(F.col("id"))
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), owner, "line"), F.lit(n))
    text = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        filled = F.lit(shape.replace("{{", "{").replace("}}", "}"))
        for name, salt, n in (("{a}", 1, 20), ("{b}", 2, 1000), ("{c}", 3, 20)):
            filled = F.replace(filled, F.lit(name), draw(salt, n).cast("string"))
        text = F.when(draw(0, len(shapes)) == i, filled).otherwise(text)
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", text.alias("t")))), lambda s: s["t"]), "\n").alias("text"))
