"""N22. Thickness, area per lipid, density profiles and order parameters of a bilayer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.expr import atom, bin_index, dot, sub
from helixframe.model import Trajectory

Z_BINS = 50


class Membrane:
    """A bilayer by its headgroup atoms; every per-frame figure is computed within the frame's row.

    headgroup: atom names, comma-separated, in any case; if none is found all atoms count.
    normal: 0, 1 or 2, the axis across the bilayer; larger numbers are 2.
    """

    def __init__(self, traj: Trajectory, headgroup: str = "P", normal: int = 2):
        self.traj, self.axis = traj, min(normal, 2)
        names = {x.strip().upper() for x in headgroup.split(",") if x.strip()}
        atoms = [r for r in traj.atom_rows if r.atom_name.upper() in names] or traj.atom_rows
        lipids: dict[tuple, int] = {}
        self.heads = [(r.atom_idx, lipids.setdefault((r.res_seq, r.chain_id), len(lipids))) for r in atoms]

    def _leaflets(self) -> DataFrame:
        """frame, median, h: the headgroups' heights with their lipids."""
        table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(lipid).alias("lipid")) for a, lipid in self.heads])
        heads = F.transform(table, lambda s: F.struct(F.get("xyz", s["a"] * 3 + self.axis).alias("z"), s["lipid"].alias("lipid")))
        rows = self.traj.whole_frames.select("frame", heads.alias("h"))
        middle = F.get(F.array_sort(F.transform("h", lambda s: s["z"])), F.lit(len(self.heads) // 2))
        return rows.withColumn("median", middle)

    @staticmethod
    def _side(upper: bool) -> Column:
        return F.filter("h", lambda s: s["z"] >= F.col("median") if upper else s["z"] < F.col("median"))

    def per_frame(self) -> DataFrame:
        """frame, thickness, apl, n_upper, n_lower; apl is 0 without a box."""

        def mean(upper: bool) -> Column:
            side = self._side(upper)
            total = F.aggregate(side, F.lit(0.0), lambda acc, s: acc + s["z"])
            return F.when(F.size(side) > 0, total / F.size(side)).otherwise(0.0)

        lipids = lambda upper: F.size(F.array_distinct(F.transform(self._side(upper), lambda s: s["lipid"])))
        rows = self._leaflets().select(
            "frame", F.abs(mean(True) - mean(False)).alias("thickness"), lipids(True).alias("n_upper"), lipids(False).alias("n_lower")
        )
        if self.traj.cells is None:
            return rows.select("frame", "thickness", F.lit(0.0).alias("apl"), "n_upper", "n_lower")
        sides = [F.col("abc"[(self.axis + k) % 3]) for k in (1, 2)]
        boxes = self.traj.cells.select("frame", (sides[0] * sides[1]).alias("area"))
        apl = F.when((F.col("area") > 0) & (F.col("n_upper") > 0), F.col("area") / F.col("n_upper")).otherwise(0.0)
        return rows.join(boxes, "frame", "left").select("frame", "thickness", F.coalesce(apl, F.lit(0.0)).alias("apl"), "n_upper", "n_lower")

    def summary(self) -> DataFrame:
        """mean_thickness, mean_apl over all frames, and the lipids of each leaflet in the first."""
        rows = self.per_frame()
        first = F.min(F.struct("frame", "n_upper", "n_lower"))
        return rows.agg(F.avg("thickness").alias("mean_thickness"), F.avg("apl").alias("mean_apl"), first.alias("f")).select(
            "mean_thickness", "mean_apl", F.col("f.n_upper").alias("n_upper"), F.col("f.n_lower").alias("n_lower")
        )

    def density(self, bins: int = Z_BINS) -> DataFrame:
        """leaflet, bin, density of headgroup heights pooled over frames, each leaflet over its own range (1 at least)."""
        parts = []
        for name, upper in (("upper", True), ("lower", False)):
            heights = self._leaflets().select(F.explode(F.transform(self._side(upper), lambda s: s["z"])).alias("z"))
            parts.append(heights.select(F.lit(name).alias("leaflet"), "z"))
        pooled = parts[0].unionByName(parts[1])
        span = pooled.groupBy("leaflet").agg(F.min("z").alias("lo"), F.greatest(F.lit(1.0), F.max("z") - F.min("z")).alias("width"))
        placed = pooled.join(F.broadcast(span), "leaflet").select("leaflet", bin_index(F.col("z"), F.col("lo"), F.col("width"), bins).alias("bin"))
        counts = placed.groupBy("leaflet", "bin").agg(F.count("*").alias("n"))
        tops = counts.groupBy("leaflet").agg(F.max("n").alias("top"))
        shares = counts.join(F.broadcast(tops), "leaflet").select("leaflet", "bin", (F.col("n") / F.col("top")).alias("density"))
        spark = self.traj.spark
        grid = spark.range(2 * bins).select(F.when(F.col("id") < bins, "upper").otherwise("lower").alias("leaflet"), (F.col("id") % bins).cast("int").alias("bin"))
        return grid.join(shares, ["leaflet", "bin"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))

    def order(self) -> DataFrame:
        """pair, label, abs_scd of each two carbons that follow one another among the selection's carbons."""
        carbons = [r for r in self.traj.atom_rows if r.element == "C"]
        structs = []
        for k, (a, b) in enumerate(zip(carbons, carbons[1:])):
            along = sub(atom("xyz", b.atom_idx), atom("xyz", a.atom_idx))
            length = F.greatest(F.sqrt(dot(along, along)), F.lit(1e-10))
            cosine = along[self.axis] / length
            structs.append(F.struct(F.lit(k).alias("pair"), F.lit(f"{a.atom_name}{a.res_seq}").alias("label"), (0.5 * (3.0 * cosine * cosine - 1.0)).alias("s")))
        if not structs:
            return self.traj.spark.createDataFrame([], "pair int, label string, abs_scd double")
        rows = self.traj.whole_frames.select(F.inline(F.array(*structs)))
        return rows.groupBy("pair", "label").agg(F.abs(F.avg("s")).alias("abs_scd"))
