"""Command line: ``python -m voxelry.cli segment|batch|sample|membranogram|show ...``.

Volumes are MRC files, guides are point texts (object 1: guide lines, object 2: a reference point), states are folders
(:mod:`voxelry.sources.state`). Lengths are in nm. ``batch`` segments many volumes, each with its own guide and state.
A run that begins anew renames a state that is there. With ``--outputs``, a point model of the result (``.mod`` text)
and the points on a few slices (``.slices``) are written too.
"""

from __future__ import annotations

import argparse
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.operators import matching, spatial
from voxelry.operators.points import normals_tangent, ordinal
from voxelry.plans import pipelines
from voxelry.sources import models, mrc, points, state
from voxelry.storage import cut

ZYX = ["z", "y", "x"]
#: Defaults for one membrane where they differ from those for two.
ONE_MEMBRANE = {"extend": 20.0, "detect_filt": 1.75}


def _segment_options(seg: argparse.ArgumentParser) -> None:
    seg.add_argument("-o", "--outputs", help="also write OUTPUTS.mod and OUTPUTS.slices")
    seg.add_argument("--membranes", type=int, choices=(1, 2), default=2)
    seg.add_argument("--pixel", type=float, help="pixel size in nm; by default the file's")
    seg.add_argument("--seed", type=int, default=0)
    d = pipelines.SegmentArgs()
    for name in ("extend", "neigh_thresh", "detect_smooth", "detect_tv", "detect_filt", "detect_supp", "components_min", "fit_shrinkside", "fit_tol", "meshrefine_spacing"):
        seg.add_argument(f"--{name}", type=float, default=None if name in ONE_MEMBRANE else getattr(d, name))
    seg.add_argument("--fit_lengrids", type=float, nargs=2, default=list(d.fit_lengrids))
    for name in ("fit_popsize", "fit_maxiter"):
        seg.add_argument(f"--{name}", type=int, default=getattr(d, name))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxelry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    seg = commands.add_parser("segment", help="find one or two membranes")
    seg.add_argument("mode", choices=("run", "runfine", "contresults", "contrefine"))
    seg.add_argument("tomo")
    seg.add_argument("model")
    seg.add_argument("--state", required=True, help="folder of the results")
    _segment_options(seg)

    many = commands.add_parser("batch", help="segment many volumes: the guide of NAME.mrc is NAME.mod, its state STATES/NAME")
    many.add_argument("mode", choices=("run", "runfine"))
    many.add_argument("tomos", nargs="+")
    many.add_argument("--states", required=True, help="folder of the states")
    _segment_options(many)

    sample = commands.add_parser("sample", help="sample places on a segmented membrane")
    sample.add_argument("method", choices=("localmax", "classify", "boxes", "strided", "excluded"))
    sample.add_argument("tomo")
    sample.add_argument("--state", required=True)
    sample.add_argument("--label", type=int, default=1)
    sample.add_argument("--box", type=float, nargs=3, default=[3, 10, 4])
    sample.add_argument("--r_exclude", type=float)
    sample.add_argument("--spacing_xy", type=float, default=5.0)
    sample.add_argument("--spacing_z", type=float, default=3.0)
    sample.add_argument("--seed", type=int, default=0)
    sample.add_argument("--pixel", type=float)
    sample.add_argument("-o", "--outputs", help="with classify or boxes: OUTPUTS.mrc, a slice for each box; with classify also OUTPUTS.classes")

    view = commands.add_parser("membranogram", help="project the density beside a membrane")
    view.add_argument("tomo")
    view.add_argument("--state", required=True)
    view.add_argument("--label", type=int, default=1)
    view.add_argument("--dists", type=float, nargs=3, default=[0, 1, 1], help="start, stop, step")
    view.add_argument("--pixel", type=float)

    show = commands.add_parser("show", help="print a state's arguments and the sizes of its steps")
    show.add_argument("--state", required=True)
    return top


def _pixel(spark: SparkSession, args: argparse.Namespace) -> float:
    if args.pixel:
        return args.pixel
    first = mrc.read_layouts(spark, args.tomo).select("pixel").first()
    return (first["pixel"] / 10) if first and first["pixel"] else 1.0


def _near(spark: SparkSession, tomo: str, cloud: DataFrame, margin: float) -> DataFrame:
    return mrc.read_near(spark, tomo, cloud, margin)


def segment(spark: SparkSession, args: argparse.Namespace) -> pipelines.Segmentation:
    pixel = _pixel(spark, args)
    for name, value in ONE_MEMBRANE.items():
        if getattr(args, name) is None:
            setattr(args, name, value if args.membranes == 1 else getattr(pipelines.SegmentArgs(), name))
    names = ("extend", "neigh_thresh", "detect_smooth", "detect_tv", "detect_filt", "detect_supp", "components_min", "fit_shrinkside", "fit_tol", "meshrefine_spacing", "fit_popsize", "fit_maxiter", "seed")
    options = pipelines.SegmentArgs(pixel_nm=pixel, fit_lengrids=tuple(args.fit_lengrids), **{n: getattr(args, n) for n in names})
    model = models.read_model(spark, args.model)
    own = model.where("object = 1")
    if own.isEmpty():
        raise SystemExit("the model has no guide lines (object 1)")
    r = model.where("object = 2").first()
    reference = (float(r["z"]), float(r["y"]), float(r["x"])) if r else None
    numbered = ordinal(own.withColumn("__line", F.monotonically_increasing_id()), "z", "__line").select(F.col("ord").alias("idx"), *ZYX)
    neigh = max(options.px(options.neigh_thresh), 1.0)
    lengths = tuple(options.px(v) for v in options.fit_lengrids)
    if args.mode in ("run", "runfine"):
        if mrc.count_files(spark, args.tomo) != 1:
            raise SystemExit("segment takes one volume; use batch for many")
        size = mrc.read_layouts(spark, args.tomo).select("ny", "nx").first()

        def voxels(low: tuple[int, ...], high: tuple[int, ...]) -> DataFrame:
            return mrc.read_voxels(spark, args.tomo, low, high).select(*ZYX, "v")

        out = pipelines.segment(voxels, numbered, (size["ny"], size["nx"]), options, args.membranes, reference, args.mode == "runfine")
    else:
        guide, matched = (state.load_step(spark, args.state, s) for s in ("guide", "match"))
        out = pipelines.finish(pipelines.Segmentation(), matched, guide, lengths, options, neigh, None, reference, simplify=args.mode == "contrefine")
    tables = out.steps | {"results": out.results, "areas": out.areas} | ({"distances": out.distances} if out.distances is not None else {})
    if args.mode in ("run", "runfine"):
        state.backup(spark, args.state)
    state.save(spark, args.state, vars(args) | {"pixel_nm": pixel}, tables)
    if args.outputs:
        bound = state.load_step(spark, args.state, "bound")
        model = cut(pipelines.output_model(bound, out.results, 2 * neigh))
        points.write_points(model, f"{args.outputs}.mod")
        models.write_models(model.withColumn("vol", F.lit("segments")), f"{args.outputs}.models", "idx")
        pipelines.output_slices(bound, out.results).write.mode("overwrite").parquet(f"{args.outputs}.slices")
    return out


def batch(spark: SparkSession, args: argparse.Namespace) -> dict[str, pipelines.Segmentation]:
    """Each volume's segmentation, by name."""
    done = {}
    for tomo in args.tomos:
        stem = tomo.removesuffix(".mrc")
        name = stem.rpartition("/")[2]
        if name in done:
            raise SystemExit(f"two volumes are named {name}")
        own = {"tomo": tomo, "model": f"{stem}.mod", "state": f"{args.states}/{name}", "outputs": args.outputs and f"{args.outputs}{name}"}
        done[name] = segment(spark, argparse.Namespace(**vars(args) | own))
    return done


def _surface(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    surface = state.load_step(spark, args.state, "results").where(F.col("label") == args.label)
    return surface.select("idx", *ZYX, *(f"n{c}" for c in ZYX))


def sample(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    pixel, surface = _pixel(spark, args), _surface(spark, args)
    if args.method == "strided":
        out = pipelines.sampling_strided(surface, pixel, args.spacing_xy, args.spacing_z, args.seed)
    elif args.method == "excluded":
        out = pipelines.sampling_excluded(surface, pixel, args.r_exclude or 10.0)
    else:
        voxels = _near(spark, args.tomo, surface, (2 + max(map(abs, args.box))) / pixel)
        out = pipelines.sampling_localmax(surface, voxels, pixel, tuple(args.box), args.r_exclude or 2.0)
        if args.method in ("classify", "boxes") and args.outputs:
            lo, hi, rt = (v / pixel for v in args.box)
            cells = cut(spatial.box_cells(normals_tangent(out), voxels, (lo, hi), rt))
            size = cells.agg(F.countDistinct("idx"), F.max("i") + 1, F.max("j") + 1).first()
            mrc.write_volume(pipelines.box_stack(cells), f"{args.outputs}.mrc", tuple(size), pixel * 10)
        if args.method == "classify":
            classed = cut(pipelines.sampling_classify(out, voxels, pixel, tuple(args.box)))
            if args.outputs:
                matching.class_averages(cells, classed.select("idx", "class")).write.mode("overwrite").parquet(f"{args.outputs}.classes")
            out = classed.where("class = 0")
    state.save(spark, args.state, state.load_args(spark, args.state), {f"sample_{args.method}_{args.label}": out})
    return out


def membranogram(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    pixel, surface = _pixel(spark, args), _surface(spark, args)
    dists = [float(d) for d in np.arange(*args.dists) / pixel]
    voxels = _near(spark, args.tomo, surface, max(map(abs, dists)) + 1)
    out = pipelines.membranogram(surface, voxels, dists)
    state.save(spark, args.state, state.load_args(spark, args.state), {f"membranogram_{args.label}": out})
    return out


def show(spark: SparkSession, args: argparse.Namespace) -> None:
    for k, v in sorted(state.load_args(spark, args.state).items()):
        print(f"{k}: {v}")
    for name in ("guide", "detect", "components", "fit", "match", "refine", "results"):
        print(f"{name}: {state.load_step(spark, args.state, name).count()} rows")


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("voxelry").getOrCreate()
    return {"segment": segment, "batch": batch, "sample": sample, "membranogram": membranogram, "show": show}[args.command](spark, args)


if __name__ == "__main__":
    main(sys.argv[1:])
