import numpy as np
import pytest

from voxelry import cli
from voxelry.operators import evolution
from voxelry.sources import models, mrc, points, state


def test_programs_end_to_end(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    y = np.arange(40)[None, :, None]
    v = 10 - 6 * np.exp(-((y - 20) ** 2) / 3.0) + rng.normal(0, 0.3, (8, 40, 40))
    tomo, model, folder = str(tmp_path / "t.mrc"), str(tmp_path / "m.txt"), str(tmp_path / "state")
    (tmp_path / "t.mrc").write_bytes(mrc.encode(v.astype("float32"), 10.0))
    lines = [f"1 1 {x} 20 {z}" for z in (1, 6) for x in range(4, 37, 3)] + ["2 1 20 -30 4"]
    (tmp_path / "m.txt").write_text("\n".join(lines))
    (tmp_path / "t.mod").write_text("\n".join(lines))
    options = "--extend 6 --detect_filt 1.2 --neigh_thresh 2 --detect_smooth 1 --detect_tv 4 --components_min 0.2 --fit_lengrids 4 12 --fit_popsize 8 --fit_maxiter 6 --meshrefine_spacing 4 --membranes 1".split()
    out = cli.main(["segment", "run", tomo, model, "--state", folder, *options], spark)
    r = out.results.selectExpr("count(*)", "percentile(y, 0.5)", "avg(ny)").first()
    assert r[0] > 50 and abs(r[1] - 20) <= 1.5 and r[2] > 0.8
    assert state.load_args(spark, folder)["pixel_nm"] == pytest.approx(1.0)
    cli.main(["show", "--state", folder], spark)
    assert "results:" in capsys.readouterr().out
    again = cli.main(["segment", "contrefine", tomo, model, "--state", folder, *options], spark)
    assert 0 < again.results.count() <= r[0]
    done = cli.main(["batch", "run", tomo, "--states", str(tmp_path / "many"), "-o", str(tmp_path / "out_"), *options], spark)
    assert set(done) == {"t"} and done["t"].results.count() == r[0]
    written = points.read_points(spark, str(tmp_path / "out_t.mod"), "double")
    assert {x.object for x in written.select("object").distinct().collect()} == {1, 2} and written.where("object = 2").count() == r[0]
    binary = models.read_model(spark, str(tmp_path / "out_t.models"), "double")
    same = lambda m: {(x.object, x.contour, round(x.x, 1), round(x.y, 1), x.z) for x in m.collect()}
    assert binary.count() == written.count() and same(binary) == same(written)
    assert 0 < spark.read.parquet(str(tmp_path / "out_t.slices")).select("z").distinct().count() <= 5
    log = evolution.evolution_log(state.load_step(spark, folder, "fit_state")).orderBy("gen").collect()
    assert len(log) == 7 and all(a.coverage >= b.coverage for a, b in zip(log, log[1:], strict=False)) and log[0].change_ratio is None
    state.backup(spark, str(tmp_path / "many" / "t"))
    assert (tmp_path / "many" / "t~" / "args").exists() and not (tmp_path / "many" / "t").exists()
    assert cli.main(["sample", "strided", tomo, "--state", folder], spark).count() > 0
    assert cli.main(["sample", "localmax", tomo, "--state", folder, "--box", "1", "3", "1", "--r_exclude", "3"], spark).count() > 0
    boxes = cli.main(["sample", "boxes", tomo, "--state", folder, "--box", "1", "3", "1", "--r_exclude", "3", "-o", str(tmp_path / "b")], spark)
    assert mrc.parse((tmp_path / "b.mrc").read_bytes())[0].shape == (boxes.count(), 3, 2)
    assert cli.main(["membranogram", tomo, "--state", folder, "--dists", "0", "2", "1"], spark).count() > 0
    with pytest.raises(SystemExit):
        cli.main(["segment", "fly", tomo, model, "--state", folder], spark)
