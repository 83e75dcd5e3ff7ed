import numpy as np
import pandas as pd

from panelscope.__main__ import main
from panelscope.schema import Config


def test_build_cpd_backtest(spark, tmp_path):
    rng = np.random.default_rng(1)
    days = pd.date_range("2019-01-01", periods=420)
    frame = pd.DataFrame({"Ticker": days.strftime("%Y-%m-%d"), "AA LN": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 420))), "BB FP": 50 * np.exp(np.cumsum(rng.normal(0, 0.01, 420)))})
    frame.to_csv(tmp_path / "p.csv", index=False)
    pd.DataFrame({"Date": frame["Ticker"], "price": frame["AA LN"]}).to_csv(tmp_path / "b.csv", index=False)
    out = str(tmp_path / "out")
    (tmp_path / "c.yaml").write_text("data:\n  raw: x\nassets: []\nlbw: 25\nreturn_horizons:\n  - [1, '1d']\n  - [5, '5d']\nvol_target: 0.1\n")
    assert Config.read(str(tmp_path / "c.yaml")) == Config(return_horizons=((1, "1d"), (5, "5d")), lbw=25, vol_target=0.1)
    (tmp_path / "c.json").write_text('{"lbw": 10, "macd_pairs": [[8, 24]]}')
    assert Config.read(str(tmp_path / "c.json")) == Config(lbw=10, macd_pairs=((8, 24),))
    main(["build", "--prices", str(tmp_path / "p.csv"), "--out-dir", str(tmp_path / "c"), "--config", str(tmp_path / "c.yaml")])
    assert "5d_log_ret" in spark.read.parquet(str(tmp_path / "c/panel.parquet")).columns
    main(["build", "--prices", str(tmp_path / "p.csv"), "--benchmark", str(tmp_path / "b.csv"), "--out-dir", out])
    assert spark.read.parquet(f"{out}/panel.parquet").count() == 840 and spark.read.parquet(f"{out}/benchmarks.parquet").count() == 840
    main(["cpd", "--lbw", "21", "--stride", "200", "--in-dir", out, "--out-dir", out])
    assert spark.read.parquet(f"{out}/cpd_21.parquet").where("nu is not null").count() >= 2
    main(["cpd", "--stride", "300", "--in-dir", out, "--out-dir", out, "--config", str(tmp_path / "c.yaml")])
    assert spark.read.parquet(f"{out}/cpd_25.parquet").count() >= 2
    main(["backtest", "--data-dir", out, "--start", "2019", "--first-test", "2020", "--end", "2021"])
    assert spark.read.parquet(f"{out}/backtest.parquet").count() == 1
    main(["train", "--data-dir", out, "--start", "2019", "--first-test", "2020", "--end", "2021", "--steps", "2"])
    held = spark.read.parquet(f"{out}/positions_0.parquet")
    assert held.where("abs(position) <= 1").count() == held.count() > 50 and spark.read.parquet(f"{out}/model_0.parquet").count() == 9
