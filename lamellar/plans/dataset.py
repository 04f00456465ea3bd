"""The dataset build as named, resumable steps."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.operators import acquire, hierarchy, imaging, presence, selection
from lamellar.sources import files as file_sources


@dataclass
class Config:
    """Defaults, overridden by a nested dict and then by dotted `key=value` items, e.g. subset.max_files=40."""

    projects: list[str] = field(default_factory=list)
    steps: list[str] = field(default_factory=lambda: ["etl", "subset", "presence", "assemble"])
    subset: dict = field(default_factory=lambda: {"max_files": None, "target_bytes": None})
    features: list[str] | None = None
    slides_dir: str = "slides"
    maf_dir: str = "mutations"
    tiling: dict = field(default_factory=lambda: {"least_tissue": 0.1, "patch": 256, "thumbnail": 1024})

    @classmethod
    def load(cls, values: dict | None = None, overrides: list[str] = ()) -> Config:
        import ast

        out = cls()
        for k, v in (values or {}).items():
            setattr(out, k, getattr(out, k) | v if isinstance(getattr(out, k), dict) else v)
        for item in overrides:
            key, _, text = item.partition("=")
            try:
                value = ast.literal_eval(text)
            except (ValueError, SyntaxError):
                value = text
            first, _, rest = key.partition(".")
            if rest:
                getattr(out, first)[rest] = value
            else:
                setattr(out, first, value)
        if not out.projects:
            raise ValueError("no projects")
        return out


class Build:
    """Steps write Parquet below `root` and are skipped while their table is there (unless forced)."""

    def __init__(self, spark: SparkSession, root: str, config: Config, tables: dict[str, DataFrame]):
        self.spark, self.root, self.config, self.tables = spark, root.rstrip("/"), config, tables
        steps = (self.etl, self.subset, self.manifest, self.mutations, self.acquire, self.tile, self.pack, self.decode, self.thumbnails, self.presence, self.assemble, self.summarise)
        self.registry: dict[str, Callable[[], DataFrame]] = {f.__name__: f for f in steps}

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str) -> DataFrame:
        if not self._exists(name):
            raise FileNotFoundError(f"step {name} hasn't run")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def chosen(self) -> DataFrame:
        """The subset's table if it is there, else the whole."""
        return self.read("subset" if self._exists("subset") else "etl")

    def run(self, force: bool = False, dry: bool = False) -> dict[str, str]:
        """dry: says what would be run, and runs nothing."""
        unknown = [s for s in self.config.steps if s not in self.registry]
        if unknown:
            raise ValueError(f"unknown steps: {', '.join(unknown)}")
        if dry:
            return {s: "skipped" if self._exists(s) and not force else "to do" for s in self.config.steps}
        status = {}
        for step in self.config.steps:
            if self._exists(step) and not force:
                status[step] = "skipped"
                continue
            self.registry[step]().write.mode("overwrite").parquet(f"{self.root}/{step}")
            status[step] = "done"
        return status

    def summary(self) -> dict[str, tuple[int, int]]:
        """Rows and columns of the tables there are."""
        return {s: (df.count(), len(df.columns)) for s in self.registry if self._exists(s) for df in [self.read(s)]}

    def etl(self) -> DataFrame:
        out = hierarchy.slide_table(self.tables["files"], self.tables["cases"], self.tables.get("mutation_files"))
        return out.where(F.col("project_id").isin(*self.config.projects))

    def subset(self) -> DataFrame:
        df, s = self.read("etl"), self.config.subset
        df = selection.byte_budget(df, "project_id", ["ingest_ord"], "file_size", s.get("target_bytes"))
        return selection.stratified_topn(df, "project_id", ["ingest_ord"], s.get("max_files"))

    def manifest(self) -> DataFrame:
        """The transfer list of the chosen slides."""
        rows = self.chosen()
        return file_sources.manifest_lines(rows.select(F.col("file_id").alias("id"), "filename", F.col("md5sum").alias("md5"), F.col("file_size").alias("size"), F.col("file_state").alias("state")))

    def mutations(self) -> DataFrame:
        """The transfer list of the chosen slides' mutation files."""
        return file_sources.mutation_manifest(self.chosen())

    def acquire(self) -> DataFrame:
        """What to do for each chosen slide. tables: `outputs` (slide_id) and `cache` (file_id) say what there is."""
        none = lambda key: self.spark.createDataFrame([], f"{key} string")
        rows = acquire.local_paths(self.chosen(), self.config.slides_dir, self.config.maf_dir)
        return acquire.acquisition(rows, self.tables.get("outputs", none("slide_id")), self.tables.get("cache", none("file_id")), "slide_id", "file_id")

    def tile(self) -> DataFrame:
        t = self.config.tiling
        return imaging.tile(self.tables["images"], t["least_tissue"], t["patch"], t["thumbnail"])

    def pack(self) -> DataFrame:
        """Tars in `<root>/tars`, named by the rows."""
        return imaging.pack_tars(self.read("tile"), f"{self.root}/tars" if "://" in self.root else f"file://{os.path.abspath(self.root)}/tars")

    def decode(self) -> DataFrame:
        return imaging.decode_with(self.read("tile"), ["simplejpeg", "opencv", "pillow"] if self.config.tiling.get("codec") == "jpeg" else ["raw"], self.config.tiling["patch"])

    def thumbnails(self) -> DataFrame:
        return imaging.thumbnails(self.tables["images"], self.config.tiling["thumbnail"])

    def summarise(self) -> DataFrame:
        """Rows and columns of the other steps' tables."""
        rows = [(s, *v) for s, v in self.summary().items() if s != "summarise"]
        return self.spark.createDataFrame(rows, "step string, rows long, columns int")

    def presence(self) -> DataFrame:
        return presence.presence_long(self.tables["mutations"], hierarchy.aliquot_to_sample(self.tables["cases"]), "aliquot_id", "sample_id", "gene")

    def assemble(self) -> DataFrame:
        long, slides = self.read("presence"), self.chosen()
        genes = self.config.features or presence.features_of(long, "gene")
        if not genes:
            return slides
        return presence.merge_presence(slides, presence.presence_wide(long, long, "sample_id", "gene", genes), "sample_id", genes)


def env_config(prefix: str = "LAMELLAR_", environ: dict | None = None) -> dict[str, str]:
    """Settings from the environment, lower-cased, without the prefix."""
    return {k.removeprefix(prefix).lower(): v for k, v in (os.environ if environ is None else environ).items() if k.startswith(prefix)}


def setting(values: dict, key: str, default: int) -> int:
    """An integer setting; unset or no number (a sentinel such as `-` or `auto`): the default."""
    try:
        return int(values.get(key) or default)
    except (TypeError, ValueError):
        return default


def compute_line(compute: dict | None) -> str:
    """The compute section as one line, `-` for what is unset."""
    c = compute or {}
    return " ".join(str(d if c.get(k) is None else c[k]) for k, d in (("batch_size", "-"), ("num_workers", "auto"), ("amp_dtype", "auto"), ("prefetch_factor", "-")))


def main(arguments: list[str] | None = None) -> dict[str, str]:
    """python -m lamellar.plans.dataset --tables DIR --root DIR --projects P1 P2 [--steps ...] [--set subset.max_files=40 ...] [--force] [--dry-run]"""
    import argparse

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--tables", required=True, help="folder of <name>.parquet: files, cases, and what the steps need (mutation_files, mutations, images, outputs, cache)")
    p.add_argument("--root", required=True)
    p.add_argument("--projects", nargs="+", required=True)
    p.add_argument("--steps", nargs="+")
    p.add_argument("--set", nargs="*", default=[], metavar="KEY=VALUE")
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    config = Config.load({"projects": a.projects} | ({"steps": a.steps} if a.steps else {}), a.set)
    folder = spark._jvm.org.apache.hadoop.fs.Path(a.tables)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    tables = {n.removesuffix(".parquet"): spark.read.parquet(f"{a.tables}/{n}") for n in names if n.endswith(".parquet")}
    status = Build(spark, a.root, config, tables).run(a.force, a.dry_run)
    for step, state in status.items():
        print(f"{step}\t{state}")
    return status


if __name__ == "__main__":
    main()
