from __future__ import annotations

import tempfile
from dataclasses import replace

from dunning.cli import main
from dunning.params import FIXTURE_PARAMS
from dunning.plans.reports import REPORTS
from dunning.plans.shared import CONTACT_LISTS, with_shared_facts
from dunning.sources.tables import from_fixture
from tests.conftest import SMOKE


def test_cli_writes_a_report(spark, capsys):
    out = tempfile.mkdtemp(prefix="dunning-cli-")
    argv = ["--tables", SMOKE, "--source", "fixture", "--report", "r05_cpc_period", "--portfolios", "517,518",
            "--start", "2025-08-15", "--end", "2025-08-20", "--as-of", "2025-10-01 12:00:00", "--out", out]
    assert main(argv, spark=spark) == 0
    line = capsys.readouterr().out.strip()
    assert line.startswith("r05_cpc_period: ") and line.endswith(f"{out}/cpc_period")
    n = int(line.split(": ")[1].split()[0])
    assert spark.read.option("header", "true").csv(f"{out}/cpc_period").count() == n


def test_cli_writes_several_reports_with_one_contract_block(spark, capsys):
    out = tempfile.mkdtemp(prefix="dunning-cli-")
    argv = ["--tables", SMOKE, "--source", "fixture", "--portfolios", "517,518,519", "--as-of", "2025-10-01 12:00:00", "--format", "parquet"]
    keys = ["r07_recent", "r08_never_contacted", "r09_broken_rejected"]
    assert main([*argv, "--report", ",".join(keys), "--out", f"{out}/all", "--min-contract-total", "1000"], spark=spark) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert [line.split(":")[0] for line in lines] == keys
    for key in keys:
        assert main([*argv, "--report", key, "--out", f"{out}/one", "--min-contract-total", "1000"], spark=spark) == 0
        name = REPORTS[key].default_name
        one, both = (sorted(map(str, spark.read.parquet(f"{out}/{d}/{name}").collect())) for d in ("one", "all"))
        assert one == both and one
    assert main([*argv, "--report", "r07_recent,r99", "--out", out], spark=spark) == 2


def test_shared_block_scans_assets_once(spark, tmp_path):
    t, p = from_fixture(spark, SMOKE), FIXTURE_PARAMS
    t.bens.write.parquet(f"{tmp_path}/bens")
    t = replace(t, bens=spark.read.parquet(f"{tmp_path}/bens"))
    scans = lambda t: sum(REPORTS[k].build(t, p)._jdf.queryExecution().optimizedPlan().toString().count("anofab#") > 0 for k in CONTACT_LISTS)
    assert scans(t) == 3
    shared = with_shared_facts(t, p, sorted(CONTACT_LISTS), str(tmp_path / "shared"))
    assert scans(shared) == 0 and len(list((tmp_path / "shared").iterdir())) == 1
    assert with_shared_facts(t, p, ["r07_recent", "r01_email"], str(tmp_path / "none")) is t


def test_cli_rejects_bad_input(spark, capsys):
    base = ["--tables", SMOKE, "--source", "fixture", "--report", "r11_largest_debts", "--out", "/tmp/x"]
    assert main(base + ["--portfolios", ""], spark=spark) == 2
    assert main(base + ["--portfolios", "517", "--min-total", "abc"], spark=spark) == 2
    assert main(base + ["--portfolios", "517"], spark=spark) == 2
    assert main(["--tables", SMOKE, "--report", "r05_cpc_period", "--out", "/tmp/x", "--portfolios", "517",
                 "--start", "2025-13-45"], spark=spark) == 2
    assert "error" in capsys.readouterr().err


def test_cli_lists_reports(capsys):
    assert main(["--list"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 11


def test_cli_explains_a_plan(spark, capsys):
    argv = ["--tables", SMOKE, "--source", "fixture", "--report", "r03_phones_top7", "--portfolios", "517",
            "--explain"]
    assert main(argv, spark=spark) == 0
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_cli_parameters_reach_the_report(spark):
    from decimal import Decimal

    from dunning.cli import build_params, jdbc_arguments, parse_args

    a = parse_args(["--portfolios", "517", "--infoad", "A, B", "--min-contract-total", "R$ 2.500,75", "--phone-slots", "3",
                    "--hist-ref-col", "cod_ref", "--zone", "America/Sao_Paulo", "--tables", "jdbc:db://h/d", "--source", "jdbc",
                    "--jdbc-option", "user=u", "--jdbc-option", "password-conf=spark.my.secret", "--jdbc-partition", "hist_tb:cod_cli:0:99:4",
                    "--jdbc-single", "stcob_tb"])
    p = build_params(a)
    assert (p.infoad, p.min_contract_total, p.phone_slots, p.hist_ref_col, p.zone) == (("A", "B"), Decimal("2500.75"), 3, "cod_ref", "America/Sao_Paulo")
    got = jdbc_arguments(a, {"spark.my.secret": "s"}.get)
    assert got == {"url": "jdbc:db://h/d", "properties": {"user": "u", "password": "s"}, "partitioning": {"hist_tb": ("cod_cli", 0, 99, 4)}, "single_connection": ("stcob_tb",)}


def test_cli_jdbc_needs_a_decision_per_table(spark, capsys):
    argv = ["--tables", "jdbc:db://h/d", "--source", "jdbc", "--report", "r01_email", "--portfolios", "517", "--out", "/tmp/x"]
    assert main(argv, spark=spark) == 2
    assert "single connection" in capsys.readouterr().err


def test_cli_lists_portfolios(capsys):
    assert main(["--list-portfolios"]) == 0
    assert capsys.readouterr().out.split() == ["517", "518", "519"]
