"""The catalog table: versioned Parquet sink and scan."""

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .schema import CATALOG, CATALOG_COLUMNS
from .shared import create, exists, names_in, remove
from .signatures import read_holding, write_signatures

_MANIFEST, _LEASES, _CLAIM = "_published", "_leases", "claim-"


class PublishConflict(RuntimeError):
    """Somebody else published after this job had looked."""


def _not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _published(spark: SparkSession, path: str) -> dict[int, str]:
    """Names of the published versions by number. The manifest has one file per version, named by its number."""
    entries = names_in(spark, f"{path.rstrip('/')}/{_MANIFEST}")
    return {int(number): name for number, _, name in (e.partition("-") for e in sorted(entries) if e[:1].isdigit())}


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the published versions, newest first."""
    return [f"{path.rstrip('/')}/{name}" for _, name in sorted(_published(spark, path).items(), reverse=True)]


def _leased(spark: SparkSession, path: str) -> set[str]:
    """Names of the versions that a reader holds; leases that have run out are taken away."""
    folder, held = f"{path.rstrip('/')}/{_LEASES}", set()
    for entry in names_in(spark, folder):
        until, _, rest = entry.partition("-")
        if int(until) < time.time():
            remove(spark, f"{folder}/{entry}")
        else:
            held.add(rest.rpartition("-")[0])
    return held


def lease(spark: SparkSession, path: str, seconds: float) -> tuple[str, str]:
    """Hold the newest version for some time: its folder and the lease, to be given to :func:`release`.

    The lease is made before the version is looked up again, so a publisher either sees the lease or the reader the newer version.
    """
    while True:
        folder = catalog_path(spark, path)
        name = folder.rpartition("/")[2]
        held = f"{path.rstrip('/')}/{_LEASES}/{int(time.time() + seconds) + 1}-{name}-{uuid.uuid4().hex}"
        create(spark, held)
        if exists(spark, folder):
            return folder, held
        release(spark, held)


def release(spark: SparkSession, held: str) -> None:
    remove(spark, held)


@contextmanager
def pinned(spark: SparkSession, path: str, seconds: float = 24 * 3600) -> Iterator[DataFrame]:
    """The newest version's rows for a job of several reads: publishers do not remove it before the block ends or the time is up."""
    folder, held = lease(spark, path, seconds)
    try:
        yield canonical(_stored(spark, folder), folder == path)
    finally:
        release(spark, held)


def write_catalog(catalog: DataFrame, path: str, partition_by_budget: bool = False, versions: int = 2, after: int | None = None) -> int:
    """Publish ``catalog`` as the newest version under ``path``; returns its rows.

    The version is written beside the others and only then named in the manifest, by creating the one file of the next
    number: of two publishers that started from the same version the second fails with :class:`PublishConflict`, and a write that
    fails half-way leaves what was published before in place. ``after`` is the number (:func:`latest`) that the
    caller's input came from, by default the one at the start. The newest ``versions`` are left, and
    older ones that a reader holds. Signatures of its files (:mod:`signatures`) let readers skip some. NaN becomes null. The row count is observed during the write, not counted again.
    """
    spark, rows = catalog.sparkSession, Observation("catalog_rows")
    seen = latest(spark, path) if after is None else after
    name = f"_version-{seen + 1:06d}-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{name}"
    clean = catalog.withColumns({c: _not_nan(F.col(c)) for c, kind in catalog.dtypes if kind in ("double", "float")})
    writer = clean.observe(rows, F.count(F.lit(1)).alias("n")).write
    if partition_by_budget:
        writer = writer.partitionBy("budget")
    writer.parquet(folder)
    write_signatures(spark, folder)
    _commit(spark, path, seen, name)
    held = _leased(spark, path)
    for old in _versions(spark, path)[versions:]:
        if old.rpartition("/")[2] not in held:
            remove(spark, old)
    return rows.get["n"]


def latest(spark: SparkSession, path: str) -> int:
    """The last number taken, 0 where there is none; a publisher that died after taking one leaves a gap."""
    taken = names_in(spark, f"{path.rstrip('/')}/{_MANIFEST}")
    return max((int(name.removeprefix(_CLAIM)) for name in taken if name.startswith(_CLAIM)), default=0)


def _commit(spark: SparkSession, path: str, seen: int, name: str) -> None:
    """Name the version in the manifest, if its number is the next one and no other publisher takes it first."""
    manifest, number = f"{path.rstrip('/')}/{_MANIFEST}", f"{seen + 1:012d}"
    if latest(spark, path) != seen or not create(spark, f"{manifest}/{_CLAIM}{number}"):
        remove(spark, f"{path.rstrip('/')}/{name}")
        raise PublishConflict(f"{path}: another job has published version {seen + 1}; start again from it")
    create(spark, f"{manifest}/{number}-{name}")


def catalog_path(spark: SparkSession, path: str) -> str:
    """Folder of the newest version; ``path`` itself if nothing was published there (a foreign table)."""
    return next(iter(_versions(spark, path)), path)


def read_catalog(spark: SparkSession, path: str, cache: bool = False, location: str | None = None, cuisine: str | None = None) -> DataFrame:
    """Scan the newest version of a catalog, or a foreign Parquet table, with the seven canonical columns.

    A text ``cuisines`` cell becomes an array of one, a null one an empty array. NaN in a foreign
    table becomes null. The scan keeps Parquet pushdown and pruning; ``cache`` holds the table over many uses.
    With ``location`` or ``cuisine`` only the files are read that can hold these substrings; rows without them may still come.
    """
    folder = catalog_path(spark, path)
    found = _stored(spark, folder)
    if folder != path and (location or cuisine):
        found = read_holding(spark, folder, location, cuisine)
    out = canonical(found, folder == path)
    return out.cache() if cache else out


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        raise FileNotFoundError(f"no catalog at {folder}: run listforge.plans.ingest.ingest first") from e


def canonical(found: DataFrame, foreign: bool, keep_file: bool = False) -> DataFrame:
    """The seven columns of a stored table, with ``keep_file`` also the path of each row's file."""
    columns = dict(found.dtypes)
    missing = [c for c in CATALOG_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"the catalog lacks columns: {', '.join(missing)}")
    cuisines = F.col("cuisines")
    if columns["cuisines"] == "string":
        cuisines = F.when(cuisines.isNotNull(), F.array(cuisines))
    cuisines = F.coalesce(F.filter(cuisines, lambda c: c.isNotNull()), F.array().cast("array<string>"))

    def read(field):
        if field.name == "cuisines":
            return cuisines.alias("cuisines")
        c = F.col(field.name).cast(field.dataType)
        # Published versions hold no NaN, so conditions on their columns reach the scan as they are.
        return (_not_nan(c) if foreign and columns[field.name] in ("double", "float") else c).alias(field.name)

    return found.select(*[read(f) for f in CATALOG.fields], *([F.col("_metadata.file_path").alias("file")] if keep_file else []))
