"""Sources and sinks: form files, catalogues, evaluation tables and the consolidated export."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import dealt, is_small, settle

# Image extensions, and the leading bytes (hexadecimal) of the known types.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
PDF_MAGIC = "25504446"
IMAGE_MAGIC = ("FFD8FF", "89504E470D0A1A0A", "424D", "49492A00", "4D4D002A")
NAME_PATTERN = r"^(.+?)[_\-\s]+(\d{1,2})[_\-\s]+([MFmf])$"


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, length, content of the files of a drop folder; Spark leaves files without a byte out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def sniff_type(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Adds `tipo`: pdf, imagen or desconocido, by extension first, then by leading bytes."""
    extension = F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(F.col(content).cast("binary"), 1, 12))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    image = reduce(lambda e, m: e | head.startswith(m), IMAGE_MAGIC, webp)
    kind = F.when(extension == "pdf", "pdf").when(extension.isin(*IMAGE_EXTENSIONS), "imagen").when(head.startswith(PDF_MAGIC), "pdf").when(image, "imagen")
    return df.withColumn("tipo", kind.otherwise("desconocido"))


def parse_form_name(df: DataFrame, col: str = "name") -> DataFrame:
    """Adds nombre, edad, sexo, valid from `name_age_sex`, the extension left off."""
    stem = F.trim(F.regexp_replace(F.col(col), r"\.[A-Za-z0-9]+$", ""))
    part = lambda i: F.regexp_extract(stem, NAME_PATTERN, i)
    valid = stem.rlike(NAME_PATTERN)
    name = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(part(1), r"[-_]", " "), r"\s+", " ")))
    return df.withColumn("valid", valid).withColumn("nombre", F.when(valid, name)).withColumn("edad", F.when(valid, part(2)).cast("int")).withColumn("sexo", F.when(valid, F.upper(part(3))))


def split_valid(df: DataFrame, policy: str = "skip", flag: str = "valid") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows. skip: bad rows are rejected; batch: one bad row rejects all."""
    if policy == "skip":
        return df.where(F.col(flag)), df.where(~F.coalesce(F.col(flag), F.lit(False)))
    bad = df.agg(F.count_if(~F.coalesce(F.col(flag), F.lit(False))).alias("__bad"))
    counted = df.crossJoin(F.broadcast(bad))  # one row
    return counted.where("__bad = 0").drop("__bad"), counted.where("__bad > 0").drop("__bad")


def cache_key(content: str = "content", sex: str = "sexo"):
    return F.concat_ws("_", F.md5(F.col(content).cast("binary")), F.col(sex))


def with_cached(df: DataFrame, cache: DataFrame, content: str = "content", sex: str = "sexo") -> DataFrame:
    """Adds cache_key, and `cached` with `resultado` of the stored result of equal work. cache: cache_key, resultado."""
    keyed = df.withColumn("cache_key", cache_key(content, sex))
    return keyed.join(cache.dropDuplicates(["cache_key"]), "cache_key", "left").withColumn("cached", F.col("resultado").isNotNull())


def distinct_work(df: DataFrame, cache: DataFrame, content: str = "content", sex: str = "sexo") -> DataFrame:
    """One row for each piece of work that no stored result covers."""
    return df.withColumn("cache_key", cache_key(content, sex)).join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at `path`, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def process_cached(df: DataFrame, fn: Callable[[dict], dict], schema: str, store: str, batch: str, content: str = "content", sex: str = "sexo") -> DataFrame:
    """The rows of `df` with cache_key, cached, the columns of `schema` from fn, ok and error. Work that the store has isn't done again, equal work is done once, and new results are stored.

    store: a folder with the results of all batches, each in a partition `lote` of its own. A batch that is repeated after a failure
    replaces what it had written; one that is repeated after it went through finds all its results. Failures aren't stored,
    so they are tried again. Two batches that run at once may both do and store the same work; one of the results is read.
    """
    spark = df.sparkSession
    fields = T.StructType.fromDDL(schema)
    keyed = df.withColumn("cache_key", cache_key(content, sex))
    nothing = spark.createDataFrame([], T.StructType([T.StructField("cache_key", T.StringType()), *fields]))
    before = stored(spark, store)
    known = nothing if before is None else before.select("cache_key", *fields.names).dropDuplicates(["cache_key"])
    todo = distinct_work(df, known, content, sex)
    done = settle(run_batch(todo, lambda row: {**fn(row), "cache_key": row["cache_key"]}, f"cache_key string, {schema}"), "results")
    new = done.where("ok").drop("ok", "error").withColumn("lote", F.lit(batch))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lote").parquet(store)
    result = lambda rows, cached: rows.select("cache_key", F.struct(*fields.names).alias("__r"), cached, *[c if c in rows.columns else F.lit(v).alias(c) for c, v in (("ok", True), ("error", None))])
    every = result(done, F.lit(False).alias("cached")).unionByName(result(known.join(keyed.select("cache_key").distinct(), "cache_key", "left_semi"), F.lit(True).alias("cached")))
    return keyed.join(every.hint("merge"), "cache_key", "left").select(*keyed.columns, "cached", "__r.*", "ok", "error")


def cache_stats(df: DataFrame, length: str = "length") -> DataFrame:
    """archivos, total_mb (two decimals)."""
    return df.agg(F.count(F.lit(1)).alias("archivos"), F.bround(F.coalesce(F.sum(length), F.lit(0)) / F.lit(1048576.0), 2).alias("total_mb"))


def run_batch(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """fn on each row, its failures kept as rows: the columns of `schema`, then ok and error.

    A failing row costs neither its batch nor its task.
    """
    fields = T.StructType.fromDDL(schema)
    out = T.StructType([*fields, T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    rows.append({**fn(row), "ok": True, "error": None})
                except Exception as failure:
                    rows.append({**{f.name: row.get(f.name) for f in fields}, "ok": False, "error": str(failure)})
            yield pd.DataFrame(rows, columns=[f.name for f in out])

    return df.mapInPandas(run, out)


def batch_counts(results: DataFrame) -> DataFrame:
    """total, hechos, errores."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("hechos"), F.count_if(~F.col("ok")).alias("errores"))


AFFINITY_SCHEMA = """config struct<peso_regla_especial: int, peso_grupo: int, peso_palabra_clave: int, peso_tipo_relacionado: int>,
 carreras map<string, array<string>>, grupos array<struct<id: string, nombre: string, carreras: array<string>>>,
 palabras_clave map<string, array<string>>, reglas array<struct<carreras: array<string>, razon: string, categoria: string>>,
 tipos_relacionados map<string, array<string>>"""
# Weights when the configuration leaves them out.
DEFAULT_WEIGHTS = {"peso_regla_especial": 5, "peso_grupo": 3, "peso_palabra_clave": 1, "peso_tipo_relacionado": 2}


def load_affinity(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The nested affinity catalogue as flat tables: types (with ordinal), groups, keywords, rules, related, weights."""
    doc = spark.read.schema(AFFINITY_SCHEMA).json(path, multiLine=True)
    return flatten_affinity(doc)


def flatten_affinity(doc: DataFrame) -> dict[str, DataFrame]:
    rules = doc.select(F.posexplode("reglas").alias("ord", "r")).where(F.size("r.carreras") == 2)
    return {
        "types": doc.select(F.explode("carreras").alias("tipo", "lista")).select("tipo", F.posexplode("lista").alias("ord", "carrera")).withColumn("ord", F.col("ord") + 1),
        "groups": doc.select(F.explode("grupos").alias("g")).select("g.id", "g.nombre", F.explode("g.carreras").alias("carrera")),
        "keywords": doc.select(F.explode("palabras_clave").alias("carrera", "lista")).select("carrera", F.explode("lista").alias("palabra")),
        "rules": rules.select("ord", F.get("r.carreras", F.lit(0)).alias("a"), F.get("r.carreras", F.lit(1)).alias("b"), F.coalesce("r.razon", "r.categoria", F.lit("Afinidad directa")).alias("razon")),
        "related": doc.select(F.explode("tipos_relacionados").alias("tipo", "lista")).select("tipo", F.explode("lista").alias("rel")),
        "weights": doc.select(*[F.coalesce(f"config.{k}", F.lit(v)).alias(k) for k, v in DEFAULT_WEIGHTS.items()]),
    }


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The semantic catalogue: ord, nombre, area, nivel and institucion as lists, perfil (six zeros if missing), keywords, alias. An entry's number is its place in the list, from 1."""
    entry = "nombre: string, area: string, nivel: string, institucion: string, perfil_riasec: array<double>, keywords: array<string>, alias: array<string>"
    doc = spark.read.schema(f"carreras array<struct<{entry}>>").json(path, multiLine=True)
    return normalize_catalog(doc.select(F.posexplode("carreras").alias("ord", "c")).select((F.col("ord") + 1).alias("ord"), "c.*"))


def _as_list(col: str):
    """A scalar or a JSON list of strings, as an array."""
    listed = F.from_json(F.col(col), "array<string>")
    return F.when(F.col(col).isNull(), F.array().cast("array<string>")).when(F.trim(F.col(col)).startswith("["), listed).otherwise(F.array(F.col(col)))


def normalize_catalog(raw: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return raw.select(
        "ord", "nombre", "area", _as_list("nivel").alias("nivel"), _as_list("institucion").alias("institucion"),
        F.coalesce("perfil_riasec", F.array_repeat(F.lit(0.0), 6)).alias("perfil"), F.coalesce("keywords", empty).alias("keywords"), F.coalesce("alias", empty).alias("alias"),
    )


def with_batch_fields(df: DataFrame, date=None, **constants) -> DataFrame:
    """Adds the batch's constants, and `fecha` as dd/mm/yyyy if a date column is given."""
    out = df.withColumns({k: F.lit(v) for k, v in constants.items()})
    return out if date is None else out.withColumn("fecha", F.date_format(date, "dd/MM/yyyy"))


def evaluation_tables(forms: DataFrame, marks: DataFrame, ranked: DataFrame, suggested: DataFrame) -> dict[str, DataFrame]:
    """The four linked tables of an evaluation, in their declared types."""
    return {
        "formulario": forms.select(F.col("form_id").cast("long"), "nombre", "sexo"),
        "marca": marks.select(F.col("form_id").cast("long"), "item", "opcion", F.when(F.col("opcion").isin("si", "ambos"), 1).otherwise(0).alias("puntaje")),
        "resultado": ranked.select(F.col("form_id").cast("long"), "tipo", F.col("pd").cast("int").alias("pd"), F.col("baremo").cast("int").alias("baremo"), F.col("posicion").cast("int").alias("posicion")),
        "carrera_sugerida": suggested.select(F.col("form_id").cast("long"), "carrera", "tipo", "es_principal"),
    }


def _of_group(groups: int):
    return F.pmod(F.xxhash64("form_id"), F.lit(groups)).cast("int")


def _in_slices(df: DataFrame, *place: str, groups: int = 16) -> DataFrame:
    """Rows dealt by their partition and slices of its forms, so that all of the session's tasks write and not one for each partition."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *place, F.pmod(F.xxhash64("form_id", F.lit(1)), F.lit(max(1, tasks // groups))))


def write_evaluation(tables: dict[str, DataFrame], dest: str, batch: str = "0", groups: int = 16) -> None:
    """Each table as Parquet below `dest`, in a partition `lote` for the batch, and within it `grupo` for a hash of form_id. A batch that is written again replaces its own rows and no others."""
    for name, df in tables.items():
        df.withColumn("grupo", _of_group(groups)).transform(_in_slices, "grupo", groups=groups).write.mode("overwrite").partitionBy("grupo").parquet(f"{dest}/{name}/lote={batch}")


def read_evaluation(spark: SparkSession, dest: str, names: Sequence[str] = ("formulario", "marca", "resultado", "carrera_sugerida")) -> dict[str, DataFrame]:
    """The tables below `dest`, with the columns lote and grupo."""
    return {name: df.withColumn("lote", F.col("lote").cast("string")) for name in names if (df := stored(spark, f"{dest}/{name}")) is not None}


def delete_stored(spark: SparkSession, dest: str, ids: DataFrame) -> None:
    """Delete the forms `ids` (form_id) and all that belongs to them from the tables below `dest`. Only partitions that have such rows are written again; one that is left empty goes."""
    gone = settle(ids.select(F.col("form_id").cast("long")).distinct(), "gone")
    for name in read_evaluation(spark, dest):
        table = spark.read.option("recursiveFileLookup", "false").parquet(f"{dest}/{name}")
        place = ["lote", "grupo"]
        touched = settle(table.join(gone, "form_id", "left_semi").select(*place).distinct(), "touched")
        rest = settle(table.join(touched, place, "left_semi").join(gone, "form_id", "left_anti"), "rest")
        _in_slices(rest, *place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*place).parquet(f"{dest}/{name}")
        # A row for each emptied partition.
        for emptied in touched.join(rest.select(*place).distinct(), place, "left_anti").collect():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{dest}/{name}/lote={emptied.lote}/grupo={emptied.grupo}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# Types of text columns in a database.
TEXT_TYPE = "VARCHAR(400)"


def write_evaluation_jdbc(tables: dict[str, DataFrame], url: str, batch: str, properties: dict[str, str] | None = None) -> None:
    """The tables in a database, with a column lote. Rows go to a staging table from all tasks; one transaction then replaces what the batch had before.

    A task that is run twice may stage its rows twice; they are made distinct on the way.
    """
    for name, df in tables.items():
        staged = f"{name}_stage"
        types = ", ".join([f"{f.name} {TEXT_TYPE}" for f in df.schema if isinstance(f.dataType, T.StringType)] + [f"lote {TEXT_TYPE}"])
        full = df.withColumn("lote", F.lit(batch))
        full.write.format("jdbc").options(url=url, dbtable=staged, createTableColumnTypes=types, **(properties or {})).mode("overwrite").save()
        full.limit(0).write.format("jdbc").options(url=url, dbtable=name, createTableColumnTypes=types, **(properties or {})).mode("append").save()
        jvm = df.sparkSession.sparkContext._jvm
        dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
        columns = ", ".join(dialect.quoteIdentifier(c) for c in full.columns)
        settings = jvm.java.util.Properties()
        for key, value in (properties or {}).items():
            settings.setProperty(key, value)
        connection = jvm.java.sql.DriverManager.getConnection(url, settings)
        try:
            connection.setAutoCommit(False)
            old = connection.prepareStatement(f"DELETE FROM {name} WHERE {dialect.quoteIdentifier('lote')} = ?")
            old.setString(1, batch)
            old.executeUpdate()
            connection.createStatement().executeUpdate(f"INSERT INTO {name} ({columns}) SELECT DISTINCT {columns} FROM {staged}")
            connection.createStatement().executeUpdate(f"DROP TABLE {staged}")
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()


def check_evaluation(forms: DataFrame, marks: DataFrame, scores: DataFrame) -> DataFrame:
    """problema, n: broken constraints and how many rows or keys break each; a row for each constraint."""
    of = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problema"), "n")
    twice = lambda df, *keys: dealt(df, "form_id", *keys).groupBy("form_id", *keys).count().where("count > 1")
    # Rows are counted by form first, so that forms are joined and not their rows.
    homeless = lambda df: df.groupBy("form_id").agg(F.count(F.lit(1)).alias("rows")).join(forms.select("form_id"), "form_id", "left_anti").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    named = lambda df, name: df.select(F.lit(name).alias("problema"), "n")
    checks = [
        of(forms.where(~F.coalesce(F.col("sexo").isin("M", "F"), F.lit(False))), "sexo"),
        of(forms.where(F.length("nombre") > 200), "nombre largo"),
        of(marks.where("item IS NULL"), "item nulo"),
        of(twice(marks.where("item IS NOT NULL"), "item"), "marca repetida"),
        of(twice(scores, "tipo"), "resultado repetido"),
        named(homeless(marks), "marca sin formulario"),
        named(homeless(scores), "resultado sin formulario"),
    ]
    return reduce(DataFrame.unionByName, checks)


def latest(df: DataFrame, n: int, when: str = "fecha_procesado", key: str = "form_id") -> DataFrame:
    """The newest n rows; the larger key first among equal times."""
    return df.orderBy(F.col(when).desc(), F.col(key).desc()).limit(n)


# States of an analysis and their labels in the export.
STATE_LABELS = {"vacio": "", "no_reconocida": "No reconocida", "sin_match": "Sin match", "analizada": "Analizada"}


def consolidated(forms: DataFrame, normed: DataFrame, written: DataFrame, types: Sequence[str], texts: int | None = None) -> DataFrame:
    """A row for each form: `Carrera i` of the written ones, `Puntaje X` and `Nivel X` of each type. texts: how many are shown; default as many as any form has."""
    if texts is None:
        texts = written.agg(F.max("ord")).first()[0] or 0
    scores = normed.groupBy("form_id").pivot("tipo", list(types)).agg(F.max("pd").alias("Puntaje"), F.max("nivel").alias("Nivel"))
    scores = scores.select("form_id", *[F.col(f"{t}_{w}").alias(f"{w} {t}") for t in types for w in ("Puntaje", "Nivel")])
    listed = written.groupBy("form_id").agg(*[F.max(F.when(F.col("ord") == i, F.col("texto"))).alias(f"Carrera {i}") for i in range(1, texts + 1)])
    return forms.select("form_id", "nombre").join(scores, "form_id", "left").join(listed, "form_id", "left")


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the consolidated table as csv (with a header, texts as they are) or parquet."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False) if fmt == "csv" else writer.format(fmt).save(path)


def delete_forms(tables: dict[str, DataFrame], ids: DataFrame, rows: int = 1_000_000) -> dict[str, DataFrame]:
    """Every table without the forms in `ids` (form_id). Up to `rows` ids, which are counted first, are broadcast; of more, each task holds its share. So no table is sorted."""
    gone = ids.select("form_id")
    gone = F.broadcast(gone) if is_small(gone, rows) else gone.hint("shuffle_hash")
    return {name: df.join(gone, "form_id", "left_anti") for name, df in tables.items()}
