"""Writing lists: unified JSON and CSV, and every source in its own format."""

import os
import re
import sqlite3

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import active
from ..schema import LIBRARY
from ..scratch import shared_folder
from ..sources.csv_lists import writer_dialect
from .columns import export_columns, hardened, known_columns, project
from .store import STRETCH

# Version of the unified format.
UNIFIED_VERSION = 2
UNIFIED_FORMAT = "unified-library"
EXPORTED = [f.name for f in LIBRARY.fields if f.name != "seq"]

# Rows of one JSON document or database. An export has as many of them as it needs.
ROWS_PER_FILE = 5_000


def exported_sources(library: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that own at least one live row."""
    owned = active(library).select(F.col("source_file_id").alias("id"))
    return sources.join(owned, "id", "left_semi")


def unified_documents(
    library: DataFrame, sources: DataFrame, rows_per_file: int = ROWS_PER_FILE, format_name: str = UNIFIED_FORMAT
) -> DataFrame:
    """One row per unified document: format, version, the sources of its rows, and its rows.

    A document holds the rows of a stretch of positions, so none outgrows a task and each can be
    imported by itself; the sources are listed in every document that needs them.
    """
    rows = active(library).withColumn("part", F.floor(F.col("seq") / rows_per_file))
    bodies = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("seq", *EXPORTED))).alias("rows"))
    owned = rows.select("part", F.col("source_file_id").alias("id")).distinct().join(sources, "id")
    heads = owned.groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("pos", "id", "name", "type", "profile"))).alias("heads")
    )
    return bodies.join(heads, "part", "left").select(
        F.lit(format_name).alias("format"),
        F.lit(UNIFIED_VERSION).alias("version"),
        F.transform("heads", lambda h: h.dropFields("pos")).alias("sources"),
        F.transform("rows", lambda r: r.dropFields("seq")).alias("bookmarks"),
    )


def write_unified_json(library: DataFrame, sources: DataFrame, path: str, **options) -> None:
    """Unified documents, one per file."""
    unified_documents(library, sources, **options).write.option("maxRecordsPerFile", 1).json(path)


def write_unified_document(library: DataFrame, sources: DataFrame, path: str, format_name: str = UNIFIED_FORMAT) -> None:
    """The whole library as one unified document at ``path``, whatever its size.

    Many tasks write its rows as lines, in order; the first begins with all that stands before the rows, the last ends the
    document, so the parts one after the other are valid. They become one file without passing through memory: on HDFS by
    ``concat``, which moves no data, elsewhere by copying the bytes. Only the list of sources is gathered.
    """
    spark = library.sparkSession
    rows = active(library)
    named = exported_sources(library, sources).select("pos", "id", "name", "type", "profile")
    listed = named.agg(F.sort_array(F.collect_list(F.struct("pos", "id", "name", "type", "profile"))).alias("s"))
    shown = listed.select(F.to_json(F.transform("s", lambda h: h.dropFields("pos")))).scalar()
    head = F.to_json(F.struct(F.lit(format_name).alias("format"), F.lit(UNIFIED_VERSION).alias("version")))
    start = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"sources":'), shown, F.lit(',"bookmarks":['))
    ends = rows.agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    first, last = ends.first()
    if first is None:
        lines = spark.range(1).select(F.concat(start, F.lit("]}")).alias("line"))
    else:
        before = F.when(F.col("seq") == first, start).otherwise(F.lit(","))
        behind = F.when(F.col("seq") == last, F.lit("]}")).otherwise(F.lit(""))
        lines = rows.orderBy("seq").select(F.concat(before, F.to_json(F.struct(*EXPORTED)), behind).alias("line"))
    folder = shared_folder(spark)
    lines.write.text(folder)
    join_parts(spark, folder, path)


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder as one file, in the order of their names."""
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    files, own = source.getFileSystem(settings), target.getFileSystem(settings)
    parts = sorted((s.getPath() for s in files.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    if own.getScheme() == "hdfs" and files.getUri().equals(own.getUri()):
        own.create(target).close()
        array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
        for k, part in enumerate(parts):
            array[k] = part
        own.concat(target, array)
        return
    out = own.create(target)
    try:
        for part in parts:
            stream = files.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
    finally:
        out.close()


def csv_rows(rows: DataFrame, keep=()) -> DataFrame:
    """Rows with tags joined and every cell hardened."""
    flat = rows.withColumn("tags", F.array_join("tags", ",", "")) if "array" in dict(rows.dtypes).get("tags", "") else rows
    return hardened(flat, keep)


def _cell(cell: Column, delimiter: str) -> Column:
    """A cell as it stands in a line: quoted where it would be read as something else."""
    odd = F.contains(cell, F.lit(delimiter)) | cell.rlike('["\r\n\ufeff]') | F.startswith(cell, F.lit(" ")) | F.endswith(cell, F.lit(" "))
    return F.when(odd, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def _write_csv(rows: DataFrame, path: str, delimiter: str, linebreak: str, partition: str | None = None) -> None:
    """Rows in the order of ``seq``, which is no column of the files, each file with a header.

    Spark's CSV writer gives the line ends within cells the line end of the file, so lines are made here and written as text.
    ``partition`` names the column that names folders; a column called ``_`` and then like it is written under its plain name.
    """
    names = [c for c in rows.columns if c not in (partition, "seq")]
    shown = [partition if c == f"_{partition}" else c for c in names]
    header = F.lit(delimiter.join(csv_cells(shown, delimiter)))
    cells = [_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), delimiter) for c in names]
    lines = rows.select(*([partition] if partition else []), "seq", F.concat_ws(delimiter, *cells).alias("line"))
    if not partition:
        # The first line of every task begins with the header.
        first = F.monotonically_increasing_id() % (1 << 33) == 0
        ordered = lines.orderBy("seq").select(F.when(first, F.concat(header, F.lit(linebreak), "line")).otherwise(F.col("line")).alias("line"))
        ordered.write.option("lineSep", linebreak).text(path)
    else:
        # Rows go by stretches of positions, so a large source is written by many tasks; every task's part of a source has a header.
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = lines.withColumn("stretch", F.floor(F.col("seq") / STRETCH))
        task = F.pmod(F.hash(partition, "stretch"), F.lit(n)).alias("task")
        heads = placed.groupBy(partition, task).agg(F.min("stretch").alias("stretch"))
        heads = heads.select(partition, F.lit(None).cast("bigint").alias("seq"), header.alias("line"), "stretch")
        dealt = placed.unionByName(heads).repartition(n, partition, "stretch").sortWithinPartitions(partition, F.col("seq").asc_nulls_first())
        dealt.select(partition, "line").write.partitionBy(partition).option("lineSep", linebreak).text(path)
    as_lists(rows.sparkSession, path)


def as_lists(spark: SparkSession, path: str) -> None:
    """Gives a finished table of text files the ending of lists; files are renamed, not copied."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files, todo = jvm_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), [jvm_path(path)]
    while todo:
        for status in files.listStatus(todo.pop()):
            at = status.getPath()
            if status.isDirectory():
                todo.append(at)
            elif at.getName().endswith(".txt"):
                files.rename(at, jvm_path(at.getParent(), at.getName().removesuffix(".txt") + ".csv"))


def csv_cells(cells: list[str], delimiter: str) -> list[str]:
    """The same for names that are known beforehand."""
    odd = re.compile("[\"\r\n\ufeff]|^ | $")
    return ['"' + c.replace('"', '""') + '"' if delimiter in c or odd.search(c) else c for c in cells]


def write_unified_csv(library: DataFrame, path: str) -> None:
    """Live rows with all columns, comma separated."""
    _write_csv(csv_rows(active(library).select("seq", *EXPORTED)), path, *writer_dialect(None, None))


def save_back(library: DataFrame, sources: DataFrame, path: str) -> list[str]:
    """Every CSV and JSON source in its own columns, and CSV in its own dialect, rows in order.

    Writes ``<path>/<n>/source_file_id=<id>/`` with one ``<n>`` per layout, and returns these folders. A CSV list
    without a layout of its own holds all columns, its ``source_file_id`` too.
    """
    described = sources.where(F.col("type").isin("csv", "json")).select(
        "id", "type", "profile", "csv_columns", "csv_dialect.delimiter", "csv_dialect.linebreak"
    )
    layout = ["type", "profile", "csv_columns", "delimiter", "linebreak"]
    written = []
    for n, kind in enumerate(described.select(*layout).distinct().collect()):
        same = F.lit(True)
        for name in layout:
            same = same & F.col(name).eqNullSafe(_literal(kind[name]))
        ids = described.where(same).select(F.col("id").alias("source_file_id"))
        rows = active(library).join(ids, "source_file_id", "left_semi")
        columns = export_columns(kind["csv_columns"], kind["profile"])
        text = kind["type"] == "csv"
        # The folders' column is written beside them under its own name.
        aside = lambda c: "_source_file_id" if text and c == "source_file_id" else c
        if columns:
            rows = project(rows, [aside(c) for c in columns if text or c != "source_file_id"], keep=("source_file_id", "seq"))
        else:
            own = [F.col(c).alias(aside(c)) for c in EXPORTED if text or c != "source_file_id"]
            rows = rows.select("source_file_id", "seq", *own)
        folder = f"{path.rstrip('/')}/{n}"
        if text:
            dialect = writer_dialect(kind["delimiter"], kind["linebreak"])
            _write_csv(csv_rows(rows, keep=("source_file_id",)), folder, *dialect, partition="source_file_id")
        else:
            dealt = rows.repartition("source_file_id", F.floor(F.col("seq") / STRETCH)).sortWithinPartitions("source_file_id", "seq")
            dealt.drop("seq").write.partitionBy("source_file_id").json(folder)
        written.append(folder)
    return written


def _literal(value):
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)


def _quoted(name: str) -> str:
    return '"' + str(name).replace('"', '""') + '"'


def _database(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One SQLite database with the rows of a group, every column as text."""
    table, columns = rows["table"].iloc[0], list(rows["columns"].iloc[0])
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE TABLE {_quoted(table)} ({', '.join(_quoted(c) + ' TEXT' for c in columns)})")
    marks = ", ".join("?" * len(columns))
    ordered = rows.sort_values("seq")
    db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({marks})", [list(v) for v in ordered["cells"]])
    db.commit()
    content = db.serialize()
    db.close()
    return pd.DataFrame({"source_file_id": [key[0]], "part": [key[1]], "name": [rows["name"].iloc[0]], "content": [content]})


def sqlite_databases(library: DataFrame, sources: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """(source_file_id, part, name, content): the SQLite sources as databases again.

    Columns the library does not know stay empty. A source is cut into databases of a bounded
    number of positions, so that none has to fit into one task whole; sources whose layout was not
    recorded are left out.
    """
    usable = sources.where(
        F.col("type").isin("sqlite", "db")
        & F.col("sqlite_layout.table").isNotNull()
        & (F.size("sqlite_layout.columns") > 0)
    ).select(F.col("id").alias("source_file_id"), "name", "sqlite_layout.table", "sqlite_layout.columns")
    known = F.create_map(*[x for n, c in known_columns().items() for x in (F.lit(n), c.cast("string"))])
    rows = (
        active(library)
        .select("source_file_id", "seq", known.alias("known"))
        .join(usable, "source_file_id")
        .select(
            "source_file_id",
            F.floor(F.col("seq") / rows_per_file).alias("part"),
            "seq",
            "name",
            "table",
            "columns",
            F.transform("columns", lambda c: F.try_element_at("known", F.lower(c))).alias("cells"),
        )
    )
    return rows.groupBy("source_file_id", "part").applyInPandas(
        _database, "source_file_id string, part long, name string, content binary"
    )


def write_files(frame: DataFrame, folder: str) -> None:
    """Write ``content`` of every row to a file; the folder must be mounted on all executors."""

    def save(batches):
        for batch in batches:
            names = []
            for source, part, name, content in zip(*(batch[c] for c in ("source_file_id", "part", "name", "content"))):
                target = os.path.join(folder, f"{source}-{part:05d}-{name}")
                with open(target + ".tmp", "wb") as out:
                    out.write(content)
                # A repeated task writes the same file again; readers never see half of one.
                os.replace(target + ".tmp", target)
                names.append(target)
            yield pd.DataFrame({"written": names})

    os.makedirs(folder, exist_ok=True)
    frame.mapInPandas(save, "written string").write.format("noop").mode("overwrite").save()


def unmapped_report(sources: DataFrame) -> DataFrame:
    """(id, name, unmapped): columns of each source that can only be written empty."""
    from .columns import unmapped

    layout = F.coalesce("csv_columns", "sqlite_layout.columns")
    return sources.where(layout.isNotNull()).select("id", "name", unmapped(layout).alias("unmapped"))
