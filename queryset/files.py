"""Sinks and scans: tables written to the shared folder and read back."""

import io
import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsemill.functions import arrays
from pulsemill.operators.records import prediction_frame
from pulsemill.plans import marts
from pulsemill.session import materialize, shared_folder
from pulsemill.sources import marts as mart_io
from pulsemill.sources import signals, tables, watch
from pulsemill.sources.named import write_named
from queryset.answers import QUALITY_TEXT, quality_responses
from queryset.base import query, r6, sql, table
from queryset.inputs import HASHED_SPLIT, PPG_RAW, SAMPLES, SIGNALS, hashed_split, samples, signal_registry
from queryset.quality import SUMMARY_SQL, prediction_summary


def _fresh(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _checksum(x):
    return arrays.total(F.transform(x, lambda v, i: v.cast("double") * (i + 1)))


CHECKSUMS = "sums AS (SELECT vec_id, sum(x * (i + 1)) AS checksum, count(*) AS n FROM ppg_raw GROUP BY vec_id)"


@query(
    "registry_file",
    sql(
        [SIGNALS, PPG_RAW, CHECKSUMS],
        f"""SELECT s.record_id, s.subject_id, 'vectors' AS dataset, CAST(s.quality_label AS BIGINT) AS quality_label,
        {r6('s.hr_ref')} AS hr_ref, s.has_acc, {r6('c.checksum')} AS ppg, '' AS activity
        FROM signals s JOIN sums c ON s.vec_id = c.vec_id""",
    ),
)
def registry_file(spark, sf):
    """A registry validated, written, and scanned with its types."""
    path = _fresh(spark)
    rows = signal_registry(spark, sf).withColumns({"dataset": F.lit("vectors"), "activity": F.lit("")})
    tables.write_registry(rows, path, ["vectors"])
    return tables.read_registry(spark, path, ["vectors"]).select(
        "record_id", "subject_id", "dataset", "quality_label", "hr_ref", "has_acc",
        _checksum(F.col("ppg")).alias("ppg"), "activity",
    )


@query("split_file", sql([HASHED_SPLIT], "SELECT subject_id, fold, CAST(7 AS BIGINT) AS seed FROM split"))
def split_file(spark, sf):
    """A split written as a table and read back to one row per subject."""
    path = _fresh(spark)
    tables.write_split(hashed_split(spark, sf), path, 7, (0.625, 0.1875, 0.1875))
    return tables.read_split(spark, path).select("subject_id", "fold", "seed")


@query(
    "prediction_file",
    sql(
        [QUALITY_TEXT],
        """SELECT 'run_a' AS run_id, record_id, subject_id, CAST(quality_label AS DOUBLE) AS y_true, y_pred,
        md5(raw_response) AS raw_response, CASE WHEN y_pred IS NULL THEN 'invalid' ELSE 'ok' END AS parse_status
        FROM quality_parsed""",
    ),
)
def prediction_file(spark, sf):
    """Prediction CSVs with whole multi-line answers, run taken from the path."""
    from pulsemill.functions.answers import parse_quality

    path = f"{_fresh(spark)}/run_a/predictions"
    rows = quality_responses(spark, sf).withColumn("p", parse_quality(F.col("raw_response")))
    tables.write_predictions(
        prediction_frame(rows, "quality", F.col("p.y_pred"), raw_response=F.col("raw_response"),
                         parse_status=F.col("p.parse_status")),
        path,
    )
    return tables.read_predictions(spark, path).select(
        "run_id", "record_id", "subject_id", "y_true", "y_pred", F.md5("raw_response").alias("raw_response"),
        "parse_status",
    )


@query(
    "annotation_file",
    sql(
        [],
        f"""SELECT CAST(o_orderkey AS VARCHAR) AS "ID", CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT)
        AS "Quality", {r6('o_totalprice')} AS "HR" FROM orders""",
    ),
)
def annotation_file(spark, sf):
    """Annotation CSVs: ids stay text."""
    path = _fresh(spark)
    table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ID"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("Quality"),
        F.col("o_totalprice").alias("HR"),
    ).write.csv(path, header=True)
    return tables.read_annotations(spark, path)


@query(
    "tensor_mart_file",
    sql(
        [SIGNALS],
        f"SELECT record_id, subject_id, {r6('hr_ref')} AS y FROM signals WHERE quality_label = 1 AND split = 'test'",
    ),
)
def tensor_mart_file(spark, sf):
    """One fold of the tensor mart; the other folders are not opened."""
    path = _fresh(spark)
    mart_io.write_tensor_mart(marts.tensor_mart(signal_registry(spark, sf), "hr"), path)
    return mart_io.read_tensor_mart(spark, path, "hr", "test").select("record_id", "subject_id", "y")


@query(
    "prompt_mart_file",
    sql(
        [SIGNALS, PPG_RAW, CHECKSUMS],
        """SELECT s.record_id, CASE WHEN s.quality_label = 1 THEN 'good' ELSE 'bad' END AS answer,
        CASE WHEN s.has_acc THEN 4 ELSE 1 END + CAST(0 AS BIGINT) AS n_series, c.n AS n_samples
        FROM signals s JOIN sums c ON s.vec_id = c.vec_id WHERE s.split = 'train'""",
    ),
)
def prompt_mart_file(spark, sf):
    """Prompt records as JSON lines, one fold read back."""
    path = _fresh(spark)
    mart = marts.prompt_mart(signal_registry(spark, sf), "quality", acc_mode="axes")
    mart_io.write_prompt_mart(mart, path)
    rows = mart_io.read_prompt_mart(spark, path, "quality", "train", mart.schema)
    first = F.get("time_series", F.lit(0))
    return rows.select(
        "record_id", "answer", F.size("time_series").alias("n_series"), F.size(first["series"]).alias("n_samples")
    )


@query("report_file", SUMMARY_SQL)
def report_file(spark, sf):
    """The evaluation report as a CSV with a fixed field order."""
    path = _fresh(spark)
    rows = prediction_summary(spark, sf)
    tables.write_report(rows.withColumn("extra", F.lit(1)), rows.columns, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query(
    "json_report_file",
    sql([HASHED_SPLIT], "SELECT fold, count(*) AS n FROM split GROUP BY fold"),
)
def json_report_file(spark, sf):
    path = _fresh(spark)
    rows = hashed_split(spark, sf).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    tables.write_json(rows, path)
    return spark.read.schema("fold STRING, n BIGINT").json(path)


# -- raw signal files, made from the embeddings --------------------------------------------------
def _npy(batch: pa.Array) -> pa.Array:
    out = []
    for row in batch:
        buffer = io.BytesIO()
        np.save(buffer, np.array(row.as_py(), dtype=np.float64))
        out.append(buffer.getvalue())
    return pa.array(out, type=pa.binary())


def _npz(names: pa.Array, channels: pa.Array) -> pa.Array:
    out = []
    for name, rows in zip(names.to_pylist(), channels.to_pylist()):
        buffer = io.BytesIO()
        np.savez(buffer, p_signal=np.array(rows, dtype=np.float32).T, sig_name=np.array(name.split(",")))
        out.append(buffer.getvalue())
    return pa.array(out, type=pa.binary())


@query(
    "decoded_windows",
    sql(
        [SIGNALS, PPG_RAW, CHECKSUMS],
        f"""SELECT s.record_id, c.n, {r6('c.checksum')} AS checksum, CAST(NULL AS VARCHAR) AS reject_reason
        FROM signals s JOIN sums c ON s.vec_id = c.vec_id WHERE s.label <> 7
        UNION ALL SELECT record_id, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), 'rejected' FROM signals WHERE label = 7""",
    ),
)
def decoded_windows(spark, sf):
    """``.npy`` contents to arrays; files of one label are cut short and must be rejected."""
    content = F.arrow_udf(_npy, "binary")(F.col("embedding"))
    files = table(spark, sf, "embeddings").withColumn("npy", content).select(
        F.format_string("/raw/%d.npy", F.col("vec_id")).alias("path"),
        F.when(F.col("label") == 7, F.substring("npy", 1, 100)).otherwise(F.col("npy")).alias("content"),
    )
    rows = signals.decode_windows(files)
    return rows.select(
        "record_id",
        F.when(F.col("x").isNotNull(), F.size("x")).alias("n"),
        _checksum(F.col("x")).alias("checksum"),
        F.when(F.col("reject_reason").isNotNull(), "rejected").alias("reject_reason"),
    )


GREEN = """
green AS (
  SELECT r.vec_id, count(*) AS n, sum(r.x * (r.i % 21 + 1)) AS checksum
  FROM ppg_raw r JOIN signals s ON r.vec_id = s.vec_id
  WHERE r.i BETWEEN CASE WHEN s.label IN (0, 1) THEN 42 ELSE 21 END AND CASE WHEN s.label IN (0, 1) THEN 62 ELSE 41 END
  GROUP BY r.vec_id)"""


@query(
    "green_channel",
    sql(
        [SIGNALS, PPG_RAW, GREEN],
        f"""SELECT s.record_id, CASE WHEN s.label <> 9 THEN g.n END AS n,
        CASE WHEN s.label <> 9 THEN {r6('g.checksum')} END AS checksum,
        CASE WHEN s.label = 9 THEN 'unexpected window length 63, expected 21' END AS reject_reason
        FROM signals s JOIN green g ON s.vec_id = g.vec_id""",
    ),
)
def green_channel(spark, sf):
    """Three-channel ``.npz`` contents to the analysis channel.

    By label: green named last, green named in the middle, unknown names, or
    names that do not fit the channels, which leaves too many samples.
    """
    label = F.col("label")
    names = (
        F.when(label < 2, "PPG_R,PPG_B,green").when(label < 6, "ppg_r,ppg_g,ppg_b")
        .when(label < 9, "a,b,c").otherwise("PPG")
    )
    channels = F.array(*[F.slice("embedding", 1 + 21 * i, 21) for i in range(3)])
    packed = F.arrow_udf(_npz, "binary")(names, channels)
    files = table(spark, sf, "embeddings").select(
        F.format_string("/raw/%d.npz", F.col("vec_id")).alias("path"), packed.alias("content")
    )
    rows = signals.extract_ppg(signals.decode_raw_ppg(files), length=21)
    return rows.select(
        "record_id", F.when(F.col("ppg").isNotNull(), F.size("ppg")).alias("n"),
        _checksum(F.col("ppg")).alias("checksum"), "reject_reason",
    )


# -- files of which each has its own name, written by the tasks ------------------------------------
def _write_lines(lines, folder: str):
    """Write sorted (home, line) rows, a piece per task below ``folder``: (home, part, piece, at, size) of each home's bytes in it."""

    def run(batches):
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        piece = f"{part}-{uuid.uuid4().hex}"
        home, start, at = None, 0, 0

        def place():
            return {"home": home, "part": part, "piece": piece, "at": start, "size": at - start}

        with fs.open_output_stream(f"{root}/{piece}") as out:
            for batch in batches:
                done = []
                rows = zip(batch.column("home").to_pylist(), batch.column("line").to_pylist())
                for own, group in itertools.groupby(rows, lambda r: r[0]):
                    if own != home:
                        done += [place()] if home is not None else []
                        home, start = own, at
                    text = "".join(f"{line}\n" for _, line in group).encode()
                    out.write(text)
                    at += len(text)
                yield pa.RecordBatch.from_pylist(done, schema)
        if home is not None:
            yield pa.RecordBatch.from_pylist([place()], schema)

    schema = pa.schema([("home", pa.string()), ("part", pa.int32()), ("piece", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
    return materialize(lines.mapInArrow(run, "home STRING, part INT, piece STRING, at LONG, size LONG"))


def _join_pieces(places, pieces: str, folder: str, header: str) -> None:
    """Write each file ``name`` below ``folder``: the header, then its pieces' bytes in the order of the parts."""

    def run(batches):
        import pyarrow.fs as pafs

        def some():
            return pa.RecordBatch.from_pydict({"name": names, "content": contents}, pa.schema([("name", pa.string()), ("content", pa.binary())]))

        fs, root = pafs.FileSystem.from_uri(pieces)
        name = piece = source = None
        names, contents, held = [], [], 0
        for row in (row for batch in batches for row in batch.to_pylist()):
            if row["name"] != name:
                name = row["name"]
                names.append(name)
                contents.append(header.encode())
            if row["piece"] != piece:
                if source:
                    source.close()
                piece = row["piece"]
                source = fs.open_input_file(f"{root}/{piece}")
            source.seek(row["at"])
            left = row["size"]
            while left:
                content = source.read(min(left, COPIED))
                if not content:
                    raise EOFError(f"{piece} is cut short")
                names.append(name)
                contents.append(content)
                left -= len(content)
                held += len(content)
                if held >= COPIED or len(names) >= NAMES:
                    yield some()
                    names, contents, held = [], [], 0
        if names:
            yield some()
        if source:
            source.close()

    # as many tasks as there are places for, however few bytes the rows have: they stand for whole files
    tasks = 4 * places.sparkSession.sparkContext.defaultParallelism
    dealt = places.repartition(tasks, "name").sortWithinPartitions("name", "part").select("name", "piece", "at", "size")
    write_named(dealt.mapInArrow(run, "name STRING, content BINARY"), folder)


#: bytes that are copied at a time, and rows in a batch
COPIED, NAMES = 4 << 20, 4096
HEADER = "timestamp,kind,signal\n"


def _recordings(spark, sf, lines: bool = True) -> str:
    """Users as participants below a folder named Projects: PPG files whose value column has no
    known name, ECG files for two of three, events for all, a second file deeper down.

    Without ``lines`` each file is its header only. The lines are sorted by ranges, so a user
    covers many tasks; a file's task only copies their bytes.
    """
    user = F.col("user_id").cast("string")
    home = F.concat(F.when(F.col("user_id") % 2 == 0, "Data/P").otherwise("P"), user).alias("home")
    kinds = (("/GalaxyWatch/a_PPG_1.csv", F.lit(True)), ("/GalaxyWatch/deep/0_PPG.csv", F.col("user_id") % 4 == 0),
             ("/Polar H10/ECG.csv", F.col("user_id") % 3 > 0), ("/day/Events.csv", F.lit(True)))
    names = F.filter(F.array(*[F.when(which, F.concat(home, F.lit(name))) for name, which in kinds]), lambda n: n.isNotNull())
    rows = samples(spark, sf).where("user_id IS NOT NULL")
    users = rows.select("user_id").distinct().select(home, F.explode(names).alias("name"))
    root = f"{_fresh(spark)}/Projects/raw"
    if not lines:
        write_named(users.select("name", F.lit(HEADER).alias("content")), root, whole=True)
        return root
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    line = F.concat_ws(",", ms, F.col("event_type"), F.col("value").cast("string")).alias("line")
    order = ("user_id", "ts", "event_id")
    pieces = _fresh(spark)
    places = _write_lines(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(home, line), pieces)
    _join_pieces(places.join(users, "home"), pieces, root, HEADER)
    return root


PEOPLE = """
people AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'Data/P' ELSE 'P' END || user_id AS home FROM events
           WHERE user_id % 3 > 0)"""


@query(
    "watch_discovery",
    sql(
        [PEOPLE],
        """SELECT 'P' || user_id AS subject_id, 'ppg' AS kind, home || '/GalaxyWatch/a_PPG_1.csv' AS path FROM people
        UNION ALL SELECT 'P' || user_id, 'ecg', home || '/Polar H10/ECG.csv' FROM people
        UNION ALL SELECT 'P' || user_id, 'event', home || '/day/Events.csv' FROM people""",
    ),
)
def watch_discovery(spark, sf):
    """Participants found below a root with a folder of its own that begins with P."""
    return watch.discover(spark, _recordings(spark, sf, lines=False))


@query(
    "watch_file_series",
    sql(
        [SAMPLES],
        f"""SELECT 'P' || subject_id AS subject_id, {r6('t')} AS t, idx, {r6('value')} AS value FROM samples
        WHERE CAST(subject_id AS BIGINT) % 3 > 0""",
    ),
)
def watch_file_series(spark, sf):
    """The series of these files: the value is their last numeric column, not a helper of the reader."""
    root = _recordings(spark, sf)
    return watch.read_signal(spark, root, watch.discover(spark, root), "ppg", watch.PPG_FS)


@query(
    "ledger_file",
    sql(
        [],
        f"""SELECT 'run' || s_suppkey AS run_id, CASE WHEN s_suppkey % 2 = 0 THEN 'cnn1d' ELSE 'trivial' END AS model,
        {r6('s_acctbal / 100e0')} AS mae FROM supplier WHERE s_suppkey % 5 NOT IN (1, 3)""",
    ),
)
def ledger_file(spark, sf):
    """Run records, one file each; some are cut short, some have a field that no record has."""
    key = F.col("s_suppkey")
    record = F.to_json(F.struct(
        F.concat(F.lit("run"), key.cast("string")).alias("run_id"),
        F.when(key % 2 == 0, "cnn1d").otherwise("trivial").alias("model"), F.lit("hr").alias("task"),
        F.lit("finished").alias("status"), F.struct((F.col("s_acctbal") / 100.0).alias("mae")).alias("metrics"),
    ))
    content = (
        F.when(key % 5 == 1, F.substring(record, 1, 40))
        .when(key % 5 == 3, F.concat(F.lit('{"surprise": 1,\n'), F.substring(record, F.lit(2), F.length(record))))
        .otherwise(F.replace(record, F.lit(","), F.lit(",\n")))
    )
    folder = _fresh(spark)
    rows = table(spark, sf, "supplier").select(F.format_string("run%d/run.json", key).alias("name"), content.alias("content"))
    write_named(rows, folder, whole=True)
    return tables.read_ledger(spark, f"{folder}/*/run.json").select("run_id", "model", "metrics.mae")


@query(
    "ecg_on_grid",
    sql(
        [SIGNALS, PPG_RAW],
        f"""SELECT s.record_id, j.j AS i,
        {r6('CAST(CAST(sum(r.x * (1e0 + 2e0 * cos(2e0 * pi() * r.i / 64e0) * CASE WHEN j.j = 0 THEN 1 ELSE -1 END)) / 64e0 AS FLOAT) AS DOUBLE)')} AS x
        FROM signals s JOIN ppg_raw r ON s.vec_id = r.vec_id CROSS JOIN (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) j(j)
        GROUP BY s.record_id, j.j""",
    ),
)
def ecg_on_grid(spark, sf):
    """ECG files of one or two dimensions, from 1000 to 30 Hz: 64 samples become two."""
    content = F.arrow_udf(_npy_flat_or_column, "binary")(F.col("embedding"), F.col("vec_id") % 2 == 0)
    files = table(spark, sf, "embeddings").select(
        F.format_string("/raw/%d.npy", F.col("vec_id")).alias("path"), content.alias("content")
    )
    return signals.ecg_files_on_grid(files).select("record_id", F.posexplode("ecg").alias("i", "x"))


def _npy_flat_or_column(batch: pa.Array, tall: pa.Array) -> pa.Array:
    out = []
    for row, upright in zip(batch, tall.to_pylist()):
        buffer = io.BytesIO()
        array = np.array(row.as_py(), dtype=np.float64)
        np.save(buffer, array[:, None] if upright else array)
        out.append(buffer.getvalue())
    return pa.array(out, type=pa.binary())
