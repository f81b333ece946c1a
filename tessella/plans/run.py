"""A reconstruction from terrain and panels to densities and errors, stage by stage, and sweeps of such runs.

A stage's tables stand below the folder under a digest of what they are made of: the version, the settings that the stage uses, the inputs it reads,
and the digests of the stages before. So a run goes on after the last stage that is whole, other settings or inputs never get an old result, and runs that
differ in some settings only share the stages that don't depend on them. A stage reads what stages before it wrote, so executors and the driver may be lost between any two.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.axis import Axis
from tessella.operators import grid, groups, invert, matrix
from tessella.operators.trace import traced
from tessella.operators.windows import dense_numbers
from tessella.plans import reconstruction
from tessella.sources import config, sinks

VERSION = 8
#: Runs side by side write a stage's common mark one after the other.
_MARKING = threading.Lock()

#: What each stage depends on besides the stages before it: settings, and inputs.
USES = {
    "build_geometry": (["axes", "center", "widths", "truth"], ["pillars", "panels"]),
    "trace_path_lengths": (["axes", "least_hits"], []),
    "compute_prior": (["densities", "truth", "least_path", "grouping", "parts", "trigger", "least_bins", "noise"], ["flux", "efficiency"]),
    "build_observation_matrix": (["seed", "draw_signal"], ["slope"]),
    "invert_density": (["sigma_rho", "corr_length", "sigma_rho_diag", "kind", "lengths"], []),
    "analyze_errors": (["prior_range"], []),
}


@dataclass
class Settings:
    """What a run needs besides terrain and panels. Densities: cells, upper, lower and lateral shell.

    grouping: `parts` (equal ones, as many as parts says) or `auto` (halved while they hold the trigger, down to least_bins). noise: parts of a bin's signal as a floor
    and as a Poisson part, and of its panel's signal by exposure, as a floor and a Poisson part. draw_signal: whether counts are drawn. prior_range: densities
    of the cells between which the prior is uncertain.
    """

    axes: list[Axis]
    center: tuple[float, float, float]
    widths: tuple[float, float, float]
    densities: tuple[float, float, float, float] = (2000.0, 2000.0, 2000.0, 2000.0)
    truth: float = 2000.0
    least_hits: int = 1
    parts: tuple[int, int] = (8, 4)
    least_path: float = 1.0
    sigma_rho: float = 300.0
    corr_length: float = 100.0
    sigma_rho_diag: float = 0.0
    seed: int = 42
    kind: str = "iso"
    lengths: tuple[float, ...] = field(default=())
    grouping: str = "parts"
    trigger: float = 1000.0
    least_bins: tuple[int, int] = (1, 1)
    noise: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    draw_signal: bool = True
    prior_range: tuple[float, float] | None = None


def content(df: DataFrame) -> str:
    """A digest of a table's rows in any order, and of its columns."""
    rows = F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)
    found = df.agg(F.count(F.lit(1)), F.bit_xor(rows[0]), F.sum(rows[0].cast("decimal(38,0)")), F.sum(rows[1].cast("decimal(38,0)"))).first()
    return digest([df.dtypes, *map(str, found)])


def digest(of: object) -> str:
    return hashlib.sha256(json.dumps(of, default=str, sort_keys=True).encode()).hexdigest()[:24]


class Run:
    """flux: of `vz` and `dl`; slope: its derivative by dl. Both are column functions, so tables or formulas serve.

    efficiency: detid, ix, iy and eff_cnt of elements, if they are not all 1.
    """

    def __init__(self, spark: SparkSession, folder: str, pillars: DataFrame, panels: DataFrame, settings: Settings, flux: Callable[[Column, Column], Column], slope: Callable[[Column, Column], Column], efficiency: DataFrame | None = None):
        self.spark, self.folder, self.pillars, self.panels, self.settings, self.flux, self.slope, self.efficiency = spark, folder.rstrip("/"), pillars, panels, settings, flux, slope, efficiency
        self._inputs: dict[str, str] = {}
        self._digests: dict[str, str] = {}
        #: Stages that were worked out rather than found, with their digests.
        self.done: list[tuple[str, str]] = []

    def with_settings(self, **changed) -> Run:
        """A run in the same folder with other settings; it shares inputs and every stage that doesn't depend on what changed."""
        out = Run(self.spark, self.folder, self.pillars, self.panels, replace(self.settings, **changed), self.flux, self.slope, self.efficiency)
        out._inputs, out.done = self._inputs, self.done
        return out

    def _input(self, name: str) -> str:
        if name not in self._inputs:
            value = getattr(self, name)
            # of a function, the expression that it makes
            self._inputs[name] = digest(None) if value is None else content(value) if isinstance(value, DataFrame) else digest(value(F.col("vz"), F.col("dl"))._jc.toString())
        return self._inputs[name]

    def digest(self, stage: str) -> str:
        if stage not in self._digests:
            settings, inputs = USES[stage]
            before = [s for s, n in config.STAGES.items() if n == config.STAGES[stage] - 1]
            own = asdict(self.settings)
            self._digests[stage] = digest([VERSION, stage, {k: own[k] for k in settings}, [self._input(i) for i in inputs], [self.digest(s) for s in before]])
        return self._digests[stage]

    def path(self, stage: str, name: str) -> str:
        return f"{self.folder}/{stage}/{self.digest(stage)}/{name}"

    def save(self, stage: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(stage, name))

    def load(self, stage: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage, name))

    def mark(self, stage: str) -> None:
        """Notes that a stage is whole: beside its tables, and in the stage's folder as the last one that was worked out."""
        text = json.dumps({"version": VERSION, "stage": stage, "digest": self.digest(stage), "settings": asdict(self.settings)}, default=str)
        with _MARKING:
            for path in (self.path(stage, "whole"), f"{self.folder}/{stage}/whole"):
                self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def whole(self, stage: str) -> bool:
        """Whether a stage was finished with these settings and inputs."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(stage, 'whole')}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def work_out(self, stage: str) -> None:
        if not self.whole(stage):
            getattr(self, stage)()
            self.mark(stage)
            self.done.append((stage, self.digest(stage)))

    def go(self, until: str | int = "analyze_errors") -> None:
        last = config.end_stage(until)
        for stage, number in config.STAGES.items():
            if number <= last:
                self.work_out(stage)

    def build_geometry(self) -> None:
        s, (x, y, z) = self.settings, self.settings.axes
        inside = grid.checked_inside(self.panels.withColumnsRenamed({"px": "x", "py": "y"}), x, y, "a panel outside the grid").withColumnsRenamed({"x": "px", "y": "py"})
        self.save("build_geometry", "panels", reconstruction.heights(inside, F.col("pz"), z.min))
        cells = grid.voxels(self.pillars, z).filter("density > 0")
        kept = grid.reconstructed(cells.filter("tf_exist"), s.axes, s.center, s.widths).select("ix", "iy", "iz", F.lit(True).alias("__in"))
        ends = kept.groupBy("ix", "iy").agg(F.min("iz").alias("__a"), F.max("iz").alias("__b"))
        marked = cells.join(kept, ["ix", "iy", "iz"], "left").join(ends, ["ix", "iy"], "left")
        kind = F.when(F.col("__in"), "cell").when(F.col("__a").isNull(), "lateral").when(F.col("iz") > F.col("__b"), "upper").otherwise("lower")
        # a cell that the surface cuts counts by its fill
        self.save("build_geometry", "cells", marked.select("ix", "iy", "iz", kind.alias("kind"), (F.col("density") / s.truth).alias("fill")))

    def trace_path_lengths(self) -> None:
        s = self.settings
        elements = reconstruction.elements(self.load("build_geometry", "panels"))
        self.save("trace_path_lengths", "elements", elements)
        elements = self.load("trace_path_lengths", "elements")
        met = traced(elements, s.axes).join(self.load("build_geometry", "cells"), ["ix", "iy", "iz"])
        met = met.select("ray_id", "ix", "iy", "iz", "kind", (F.col("length") * F.col("fill")).alias("value")).groupBy("ray_id", "ix", "iy", "iz", "kind").agg(F.sum("value").alias("value"))
        self.save("trace_path_lengths", "lengths", met)
        met = self.load("trace_path_lengths", "lengths")
        seen = met.filter("kind = 'cell'").groupBy("ix", "iy", "iz").agg(F.countDistinct(F.shiftright("ray_id", 32)).alias("n_hit"))
        numbers = dense_numbers(seen.filter(F.col("n_hit") >= s.least_hits).select("ix", "iy", "iz"), ["iz", "iy", "ix"], "col")
        self.save("trace_path_lengths", "numbers", numbers)
        shells = met.filter("kind <> 'cell'").groupBy("ray_id", "kind").agg(F.sum("value").alias("pl"))
        self.save("trace_path_lengths", "shells", shells)

    def compute_prior(self) -> None:
        s, stage = self.settings, "trace_path_lengths"
        elements, lengths, numbers = (self.load(stage, n) for n in ("elements", "lengths", "numbers"))
        own = lengths.filter("kind = 'cell'")
        inside = own.join(numbers, ["ix", "iy", "iz"], "left_semi").groupBy("ray_id").agg(F.sum("value").alias("pl"))
        left_out = own.join(numbers, ["ix", "iy", "iz"], "left_anti").groupBy("ray_id").agg(F.sum("value").alias("pl"))
        priced = {}
        if self.efficiency is not None:
            elements = elements.join(self.efficiency.select("detid", "ix", "iy", "eff_cnt"), ["detid", "ix", "iy"]).withColumn("sot", F.col("sot") * F.col("eff_cnt")).drop("eff_cnt")
        for name, densities in (("prior", s.densities), ("truth", (s.truth,) * 4)):
            paths = reconstruction.rebuilt_prior(self.load(stage, "shells"), inside, left_out, densities)
            out = elements.join(paths, "ray_id").filter(F.col("pl") >= s.least_path)
            priced[name] = out.withColumn("n", self.flux(F.col("vz"), F.col("dl")) * F.col("sot"))
        self.save("compute_prior", "prior", priced["prior"])
        seen = priced["truth"].withColumns({"signal": F.col("n"), "noise_det": F.lit(0.0), "noise_poi": F.lit(0.0)})
        seen = groups.with_noise(seen, ["detid"], *s.noise, 0.0).select("ray_id", "detid", "ix", "iy", "signal", "noise_det", "noise_poi")
        panels = self.load("build_geometry", "panels").select("detid", "nbinx", "nbiny")
        if s.grouping == "auto":
            weight = F.coalesce(F.col("signal") + F.col("noise_poi"), F.lit(0.0)).alias("weight")
            bins = elements.select("detid", "ix", "iy").join(seen, ["detid", "ix", "iy"], "left").select("detid", "ix", "iy", weight)
            divided = groups.auto_divided(bins, "detid", s.trigger, *s.least_bins)
            self.save("compute_prior", "elements", seen.join(divided, ["detid", "ix", "iy"]).select("ray_id", "detid", "igroup", "signal", "noise_det", "noise_poi"))
            return
        wide, high = (F.ceil(F.col(n) / p) for n, p in (("nbinx", s.parts[0]), ("nbiny", s.parts[1])))
        igroup = F.floor(F.col("ix") / wide) + F.floor(F.col("iy") / high) * F.ceil(F.col("nbinx") / wide)
        seen = seen.join(panels, "detid").withColumn("igroup", igroup.cast("int"))
        self.save("compute_prior", "elements", seen.select("ray_id", "detid", "igroup", "signal", "noise_det", "noise_poi"))

    def build_observation_matrix(self) -> None:
        lengths, numbers = self.load("trace_path_lengths", "lengths"), self.load("trace_path_lengths", "numbers")
        prior, elements = self.load("compute_prior", "prior"), self.load("compute_prior", "elements")
        ids = dense_numbers(elements.select("detid", "igroup").distinct(), ["detid", "igroup"], "grp")
        self.save("build_observation_matrix", "groups", ids)
        ids = self.load("build_observation_matrix", "groups")
        grouped = elements.join(ids, ["detid", "igroup"]).select(F.col("ray_id").alias("row"), "grp")
        slopes = prior.select(F.col("ray_id").alias("row"), (self.slope(F.col("vz"), F.col("dl")) * F.col("sot")).alias("factor"))
        self.save("build_observation_matrix", "matrix", reconstruction.observation(lengths.filter("kind = 'cell'").withColumnRenamed("value", "length"), numbers, slopes, grouped))
        expected = prior.select(F.col("ray_id").alias("row"), "n").join(grouped, "row").groupBy("grp").agg(F.sum("n").alias("expected"))
        signal = groups.sums(elements.join(ids, ["detid", "igroup"]), ["detid", "igroup", "grp"], ["signal", "noise_det", "noise_poi"])
        seen = groups.observed_counts(signal, ["detid", "igroup"], self.settings.draw_signal, self.settings.seed)
        # the floor of the noise is known and is no part of what is compared; its Poisson part is expected
        floor = F.col("noise_det")
        seen = seen.withColumns({"observed": F.col("observed") - floor, "noise": F.col("noise_poi")})
        self.save("build_observation_matrix", "counts", seen.join(expected, "grp").select("detid", "igroup", "grp", "observed", (F.col("expected") + F.col("noise")).alias("expected"), (F.col("observed") + floor).alias("variance")))

    def _system(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        s, (x, y, z) = self.settings, self.settings.axes
        counts = self.load("build_observation_matrix", "counts").filter("observed > 0")
        observed = counts.select(F.col("detid").alias("owner"), F.col("grp").alias("row"), (F.col("observed") - F.col("expected")).alias("residual"), "variance")
        rows = self.load("build_observation_matrix", "matrix").join(counts.select(F.col("grp").alias("row"), F.col("detid").alias("owner")), "row")
        at = [a.center(F.col(f"i{n}")).alias(n) for a, n in zip((x, y, z), "xyz", strict=True)]
        unknowns = self.load("trace_path_lengths", "numbers").select("col", *at, F.lit(s.densities[0]).alias("prior"))
        return rows, observed, unknowns

    def _kernel(self):
        s = self.settings
        return invert.prior_covariance(s.sigma_rho, s.lengths or (s.corr_length,), s.kind, s.sigma_rho_diag)

    def invert_density(self) -> None:
        rows, observed, unknowns = self._system()
        one = F.lit(-1).alias("run")
        out = invert.solved(rows.select(one, "row", "col", "value"), observed.select(one, "row", "residual", "variance"), unknowns, self._kernel())
        self.save("invert_density", "densities", out.drop("run"))
        change = self.load("invert_density", "densities").join(unknowns.select("col", "prior"), "col").select("col", (F.col("density") - F.col("prior")).alias("x"))
        left = observed.join(matrix.times_vector(rows, change), "row").withColumn("residual", F.col("residual") - F.col("value"))
        self.save("invert_density", "chi_square", invert.chi_square(left.withColumn("model", F.lit("center")), ["model"]))

    def analyze_errors(self) -> None:
        rows, observed, unknowns = self._system()
        owners = [r["owner"] for r in observed.select("owner").distinct().orderBy("owner").collect()]  # panels
        _, loo = reconstruction.with_leave_one_out(rows, observed, unknowns, self._kernel(), owners)
        out = self.load("invert_density", "densities").join(loo, "col", "left")
        if self.settings.prior_range:
            between = [self._shifted(rho).withColumnRenamed("density", name) for name, rho in zip(("prior_low", "prior_high"), self.settings.prior_range, strict=True)]
            out = out.join(between[0], "col").join(between[1], "col")
        else:
            prior = F.lit(self.settings.densities[0])
            out = out.withColumns({"prior_low": prior, "prior_high": prior})
        parts = out.select("col", "density", F.col("error").alias("stat"), F.coalesce("loo", F.lit(0.0)).alias("loo"), "prior_low", "prior_high")
        self.save("analyze_errors", "errors", invert.mixed(parts))

    def _shifted(self, rho: float) -> DataFrame:
        """col and density of the solution from another prior density of the cells: a run of its own up to the inversion, which shares this one's geometry and paths."""
        other = self.with_settings(densities=(rho, *self.settings.densities[1:]))
        other.go("invert_density")
        return other.load("invert_density", "densities").select("col", "density")


@dataclass
class Sweep:
    """Runs over all combinations of densities (one, or four with the shells), sigmas, lengths and diagonals; see config.sweep_points.

    Stages that points share are worked out once; up to `at_once` different ones side by side.
    """

    base: Run
    sigmas: list[float]
    lengths: list[float]
    densities: list = field(default_factory=list)
    diagonals: list[float] | None = None
    errors: str = "none"
    selected: list[int] = field(default_factory=list)
    at_once: int = 1

    def points(self) -> list[tuple[dict, Run, bool]]:
        """Of each point what it is, its run, and whether its errors are analysed. A density of -1 stands for the base's."""
        found = config.sweep_points(self.sigmas, self.lengths, self.densities, self.diagonals)
        out = []
        for p in found:
            densities = tuple(p["density"]) if p["density"][0] >= 0 else self.base.settings.densities
            run = self.base.with_settings(densities=densities, sigma_rho=p["sigma_rho"], corr_length=p["corr_length"], sigma_rho_diag=p["sigma_rho_diag"])
            out.append((p, run, config.errors_wanted(self.errors, p["index"], len(found), self.selected)))
        return out

    def go(self, until: str | int = "analyze_errors") -> DataFrame:
        """The sweep's summary, which is written to the folder too if it went to the end."""
        last, points = config.end_stage(until), self.points()
        if last < config.STAGES["invert_density"]:
            raise ValueError("a sweep goes to invert_density at least")
        for stage, number in config.STAGES.items():
            if number > last:
                break
            wanted = {run.digest(stage): run for _, run, errors in points if errors or stage != "analyze_errors"}
            with ThreadPoolExecutor(self.at_once) as pool:
                list(pool.map(lambda run, stage=stage: run.work_out(stage), wanted.values()))
        analysed = [errors and last >= config.STAGES["analyze_errors"] for *_, errors in points]
        if last >= config.STAGES["analyze_errors"]:
            sinks.write_sweep(self.base.spark, [p for p, *_ in points], analysed, f"{self.base.folder}/sweep_summary.csv")
        return sinks.sweep_summary(self.base.spark, [p for p, *_ in points], analysed)

    def densities_of_all(self) -> DataFrame:
        """index, label, col, density and error of every point."""
        out = None
        for p, run, _ in self.points():
            one = run.load("invert_density", "densities").select(F.lit(p["index"]).alias("index"), F.lit(p["label"]).alias("label"), "col", "density", "error")
            out = one if out is None else out.unionByName(one)
        return out
