"""Parquet tables in versions: a merge writes the next version of the parts that it touches, and readers then see it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog_lake.session import materialise

PART = "__part"
#: Files that say what a folder is: a version that is complete, a part without rows, a cold part that replaces its older files.
COMPLETE, EMPTY, WHOLE = "_COMPLETE", "_EMPTY", "_WHOLE"


class VersionedTable:
    """A table dealt to ``parts`` by a hash of its keys; a version holds the parts that its merge touched.

    A version is complete when its mark is there, which is written last. Readers take each part from the newest
    complete version that has it, so that a merge may read the table which it writes, and a merge of few keys
    rewrites few parts. A part that a merge empties is kept as an empty folder, so that deletions hold. Writing a
    version again replaces it, as a repeated micro-batch does. One writer at a time.

    ``cold`` is a condition on rows that are finished, such as ``download_done >= 3``. They lie in parts of their
    own, ``parts`` to 2 * ``parts`` - 1, whose files add up: rows that become cold are appended. A merge rewrites the
    touched hot parts, and reads of the cold ones only the rows of its keys; a cold part is rewritten, whole, only
    if one of these changes, goes, or becomes hot again. All other cold files stay as they are.

    Of each part the newest two states stay, for readers that began before the last write; what only older
    ones need is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str] = (), parts: int = 1, cold: str | None = None) -> None:
        if (parts > 1 or cold) and not keys:
            raise ValueError("a table of several parts needs keys")
        self.spark, self.path, self.schema, self.keys, self.parts, self.cold = spark, path.rstrip("/"), schema, tuple(keys), parts, cold

    # ---- folders

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _mark(self, name: str) -> None:
        fs = self._fs()
        fs.mkdirs(self._path(name).getParent())
        fs.create(self._path(name), True).close()

    def _listed(self, name: str, prefix: str) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path(name)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path(name))]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def versions(self) -> dict[int, list[int]]:
        """The parts of each complete version: as many folder names as versions of parts that are kept."""
        fs = self._fs()
        return {v: self._listed(f"v={v}", f"{PART}=") for v in self._listed("", "v=") if fs.exists(self._path(f"v={v}/{COMPLETE}"))}

    def _states(self, before: int | None = None) -> dict[int, list[list[int]]]:
        """For each part the versions whose files make its states, newest state first."""
        fs, states = self._fs(), {}
        for version, held in sorted(self.versions().items()):
            for p in held if before is None or version < before else ():
                older = states.setdefault(p, [])
                adds = p >= self.parts and older and not fs.exists(self._path(f"v={version}/{PART}={p}/{WHOLE}"))
                older.insert(0, [*older[0], version] if adds else [version])
        return states

    # ---- rows

    def _is_cold(self) -> Column:
        return F.coalesce(F.expr(self.cold), F.lit(False)) if self.cold else F.lit(False)

    def part(self) -> Column:
        """The hot part of a row as a column."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int") if self.parts > 1 else F.lit(0)

    def touched(self, rows: DataFrame) -> list[int]:
        """The parts that rows fall to: ``parts`` numbers at most."""
        return sorted(r[0] for r in rows.select(self.part()).distinct().collect())

    def read(self, before: int | None = None, parts: Sequence[int] | None = None) -> DataFrame:
        states = self._states(before)
        folders = [f"{self.path}/v={v}/{PART}={p}" for p, s in sorted(states.items()) if parts is None or p in parts for v in s[0]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int, parts: Sequence[int] | None = None, whole: Sequence[int] | None = None) -> None:
        """Write rows as a version: ``parts`` are the hot parts that it replaces, ``whole`` the cold ones; all, unless they are given."""
        cold = range(self.parts, 2 * self.parts) if self.cold else ()
        parts, whole = range(self.parts) if parts is None else parts, cold if whole is None else whole
        dealt = df.withColumn(PART, self.part() + F.when(self._is_cold(), self.parts).otherwise(0))
        dealt = dealt.repartition(self.parts, PART) if self.parts > 1 else dealt
        dealt.write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/v={version}")
        there = self._listed(f"v={version}", f"{PART}=")
        for p in sorted({*parts, *whole} - {*there}):
            self._mark(f"v={version}/{PART}={p}/{EMPTY}")
        for p in whole:
            self._mark(f"v={version}/{PART}={p}/{WHOLE}")
        self._mark(f"v={version}/{COMPLETE}")
        self._drop_old()

    def _drop_old(self) -> None:
        fs, needed = self._fs(), {(v, p) for p, states in self._states().items() for s in states[:2] for v in s}
        for version, held in self.versions().items():
            if old := [p for p in held if (version, p) not in needed]:
                for name in [f"v={version}"] if len(old) == len(held) else [f"v={version}/{PART}={p}" for p in old]:
                    fs.delete(self._path(name), True)

    def merge(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> list[int]:
        """Write ``how(stored, rows)`` of the parts that rows touch as the next version (or ``version``); the hot parts.

        stored has all hot rows of these parts, and the cold rows with a key of ``rows``. ``how`` may change, add and
        leave out rows, but not change keys.
        """
        next_version = max(self.versions(), default=-1) + 1 if version is None else version
        parts = self.touched(rows)
        if not parts:
            return parts
        hot = self.read(before=next_version, parts=parts)
        if not self.cold:
            self.write(how(hot, rows), next_version, parts)
            return parts
        keys = list(self.keys)
        cold_parts = [self.parts + p for p in parts]
        hits = materialise(self.read(before=next_version, parts=cold_parts).join(rows.select(*keys).distinct(), keys, "left_semi"), "cold-hits")
        merged = materialise(how(hot.unionByName(hits), rows).select(*hot.columns), "merged")
        now_cold = merged.filter(self._is_cold())
        # hits that aren't there as they were; NULLs are equal in set operations
        changed = [self.parts + p for p in self.touched(hits.subtract(now_cold))]
        place = self.part() + self.parts
        kept = self.read(before=next_version, parts=changed).join(hits.select(*keys), keys, "left_anti")
        added = now_cold.join(hits.select(*keys), keys, "left_anti")
        again = now_cold.join(hits.select(*keys), keys, "left_semi").filter(place.isin(changed))
        self.write(merged.filter(~self._is_cold()).unionByName(kept).unionByName(added).unionByName(again), next_version, parts, changed)
        return parts

    def delete(self, rows: DataFrame, version: int | None = None) -> list[int]:
        """Merge that leaves out the stored rows with a key of ``rows``."""
        keys = list(self.keys)
        return self.merge(rows.select(*keys).distinct(), lambda stored, gone: stored.join(gone, keys, "left_anti"), version)

    def compact(self) -> None:
        """A version of all rows, in which each cold part is one set of files again."""
        self.write(materialise(self.read(), "compacted"), max(self.versions(), default=-1) + 1)
