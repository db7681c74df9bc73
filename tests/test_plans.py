"""The whole chain on generated files: yearly exports, monthly pages, rates."""

import csv
import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from noticework.plans import labelling, products, register, reports
from noticework.plans.run import Inputs, build_products, write_quality_reports

COMMON = ["YEAR", "ISO_COUNTRY_CODE", "DT_DISPATCH", "TYPE_OF_CONTRACT", "CAE_TYPE", "MAIN_ACTIVITY", "TOP_TYPE", "B_FRA_AGREEMENT", "B_EU_FUNDS", "CPV",
          "TAL_LOCATION_NUTS", "CANCELLED", "VALUE_EURO", "VALUE_EURO_FIN_1"]
AWARD = ["ID_AWARD", "ID_LOT_AWARDED", "AWARD_VALUE_EURO", "AWARD_VALUE_EURO_FIN_1", "AWARD_EST_VALUE_EURO", "WIN_NAME", "WIN_COUNTRY_CODE", "WIN_NATIONALID",
         "B_CONTRACTOR_SME", "NUMBER_OFFERS", "NUMBER_TENDERS_OTHER_EU", "NUMBER_TENDERS_NON_EU", "DT_AWARD", "TITLE"]


def _write(path, columns, rows):
    with open(path, "w", newline="") as f:
        writer = csv.DictWriter(f, columns)
        writer.writeheader()
        writer.writerows(rows)


def _row(year, country, day, **more):
    base = dict.fromkeys(COMMON, "")
    base |= {"YEAR": year, "ISO_COUNTRY_CODE": country, "DT_DISPATCH": day, "TYPE_OF_CONTRACT": "S", "CAE_TYPE": "3", "MAIN_ACTIVITY": "Health",
             "TOP_TYPE": "OPE", "B_FRA_AGREEMENT": "N", "B_EU_FUNDS": "Y", "CPV": "33100000", "TAL_LOCATION_NUTS": "FR101", "CANCELLED": "0", "VALUE_EURO_FIN_1": "50000"}
    return base | more


def _notice(number, form, day, **more):
    base = {"publication-number": number, "publication-date": day + "+02:00", "dispatch-date": day + "+02:00", "notice-type": "x", "form-type": form,
            "procedure-identifier": ["proc-" + number.split("-")[0][-1]], "buyer-country": ["FRA"], "buyer-name": {"fra": ["Mairie"]}, "main-activity": ["gen-pub"],
            "buyer-legal-type": ["la"], "classification-cpv": ["72000000", "30000000"], "place-of-performance": ["FR1", "FR101"], "contract-nature": ["services"],
            "procedure-type": "open", "title-proc": {"fra": ["Panneaux solaires"], "deu": "Solar"}, "description-proc": {"fra": "Une description " * 10},
            "estimated-value-lot": ["1000", "x", "2000"], "estimated-value-cur-lot": ["PLN"], "framework-agreement-lot": ["none", None], "eu-fund-lot": ["no-eu-funds"]}
    return base | more


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    calls = [_row("2020", "FR", "31/01/20", ID_NOTICE_CN="2020000001", FUTURE_CAN_ID="2020000010", LOTS_NUMBER="2"),
             _row("2020", "FR", "31/01/20", ID_NOTICE_CN="2020000001", FUTURE_CAN_ID="2020000010", LOTS_NUMBER="2", CPV=""),
             _row("2016", "DE", "05-JAN-16", ID_NOTICE_CN="2016000002", MAIN_ACTIVITY="Airport\\related", B_FRA_AGREEMENT="Y"),
             _row("2015", "DE", "05-JAN-15", ID_NOTICE_CN="2015000003"), _row("2023", "DE", "15/10/23", ID_NOTICE_CN="2023000004"), _row("2020", "DE", "bad", ID_NOTICE_CN="2020000005")]
    _write(root / "calls.csv", ["ID_NOTICE_CN", *COMMON, "FUTURE_CAN_ID", "LOTS_NUMBER"], calls)
    win = {"WIN_NAME": "Alpha Travaux SA", "WIN_COUNTRY_CODE": "FR", "WIN_NATIONALID": "123456789", "B_CONTRACTOR_SME": "Y", "NUMBER_OFFERS": "1", "DT_AWARD": "01/03/20"}
    awards = [_row("2020", "FR", "15/03/20", ID_NOTICE_CAN="2020000010", ID_AWARD="a", AWARD_VALUE_EURO="100.5", AWARD_VALUE_EURO_FIN_1="100", **win),
              _row("2020", "FR", "15/03/20", ID_NOTICE_CAN="2020000010", ID_AWARD="a", AWARD_VALUE_EURO="100.5", **win),
              _row("2020", "FR", "15/03/20", ID_NOTICE_CAN="2020000010", ID_AWARD="b", AWARD_VALUE_EURO="50", **(win | {"WIN_COUNTRY_CODE": "DE---FR", "NUMBER_OFFERS": "3.6"})),
              _row("2023", "FR", "15/12/23", ID_NOTICE_CAN="2023000011", ID_AWARD="a", **win)]
    _write(root / "awards.csv", ["ID_NOTICE_CAN", *COMMON, *AWARD], awards)
    _write(root / "rates.csv", ["currency", "month", "rate"], [{"currency": "PLN", "month": "2024-05", "rate": "4.0"}])
    pages = root / "pages"
    pages.mkdir()
    may = [_notice("1-2024", "competition", "2024-05-02"), _notice("2-2024", "competition", "2024-05-03", **{"procedure-identifier": "proc-1"}),
           _notice("3-2024", "result", "2024-05-20", **{"procedure-identifier": ["proc-1"], "total-value": 9000, "total-value-cur": "EUR", "winner-name": {"fra": ["A", "B"]},
                                                         "winner-country": ["FRA", "DEU"], "organisation-identifier-tenderer": ["1", "2"], "winner-size": ["large"]}),
           _notice("4-2024", "change", "2024-05-21")]
    with gzip.open(pages / "2024-05.jsonl.gz", "wt") as f:
        f.write(json.dumps({"notices": may[:2], "totalNoticeCount": 4}) + "\n" + json.dumps({"notices": may[2:]}) + "\n")
    # A page row repeats an export notice at the seam.
    with gzip.open(pages / "2024-06.jsonl.gz", "wt") as f:
        f.write(json.dumps({"notices": [_notice("1-2020", "competition", "2024-06-01")]}) + "\n")
    return Inputs(str(root / "calls.csv"), str(root / "awards.csv"), str(pages), str(root / "rates.csv"))


@pytest.fixture(scope="module")
def tables(spark, inputs, tmp_path_factory):
    return build_products(spark, inputs, str(tmp_path_factory.mktemp("out")), spread=2)


def _by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_export_notices(tables):
    cn = _by(tables["notice_cn"], "id")
    assert set(cn) == {"2020000001", "2016000002"}
    assert cn["2020000001"]["n_rows"] == 2 and cn["2020000001"]["cpv"] == "33100000" and cn["2020000001"]["lots"] == 2 and cn["2020000001"]["nuts2"] == "FR10"
    assert cn["2016000002"]["dispatch_date"] == dt.date(2016, 1, 5) and cn["2016000002"]["main_activity"] == "Airport related" and cn["2016000002"]["framework"] is True
    can = _by(tables["notice_can"], "id")
    assert set(can) == {"2020000010"} and can["2020000010"]["awards"] == 2 and can["2020000010"]["award_value_sum"] == 150.5
    award = _by(tables["award"], "award_id")
    assert len(award) == 2 and award["a"]["n_rows"] == 2 and award["b"]["offers"] == 4 and award["a"]["award_date"] == dt.date(2020, 3, 1)


def test_page_notices(tables):
    api = _by(tables["notice_api"], "pub_number")
    first = api["1-2024"]
    assert first["type"] == "cn" and first["country"] == "FR" and first["lang"] == "fra" and first["title"] == "Panneaux solaires" and first["cpv"] == "72000000"
    assert first["est_value_lots"] == 3000.0 and first["framework"] is False and first["eu_funds"] is False and first["nuts2"] is None and str(first["month"]) == "2024-05"
    assert len(first["description"]) == 160 and api["4-2024"]["type"] is None and len(api) == 5


def test_history(tables):
    rows = _by(tables["notice_all"], "type", "pub_number")
    assert len(rows) == tables["notice_all"].count() == 6
    assert rows[("cn", "1-2020")]["source"] == "api" and rows[("cn", "2-2016")]["activity"] == "airport" and rows[("cn", "2-2016")]["buyer_type"] == "regional-local"
    assert rows[("cn", "1-2024")]["value_eur"] == 750.0 and rows[("can", "3-2024")]["value_eur"] == 9000.0 and rows[("cn", "1-2020")]["value_eur"] is None
    assert rows[("can", "10-2020")]["procedure"] == "open" and rows[("can", "10-2020")]["awards"] == 2


def test_page_awards(tables):
    rows = _by(tables["award_api"], "winner")
    assert rows["A"]["winner_country"] == "FRA" and rows["B"]["winner_id"] == "2" and rows["A"]["winner_size"] is None and rows["A"]["value_eur_winner"] == 4500.0


def test_quality_reports(tables, tmp_path):
    write_quality_reports(tables, str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 8
    monthly = _by(reports.monthly_procedures(tables["notice_all"]), "type", "country", "month")
    assert monthly[("cn", "FR", dt.date(2024, 5, 1))]["procedures"] == 1 and monthly[("cn", "FR", dt.date(2024, 5, 1))]["notices"] == 3
    link = _by(reports.call_to_award(tables["notice_cn"], tables["notice_can"], tables["notice_all"]), "source", "year", "country")
    assert link[("csv", 2020, "FR")]["lag_med_days"] == 44.0 and link[("csv", 2016, "DE")]["linked"] == 0.0 and link[("api", 2024, "FR")]["lag_med_days"] == 18.0
    won = _by(reports.export_winners(tables["award"], tables["notice_can"]), "year", "country")[(2020, "FR")]
    assert won["awards"] == 2 and won["single_bid"] == 0.5 and won["cross_border"] == 0.5
    coverage = reports.field_coverage(tables["notice_all"])
    assert _by(coverage, "type", "year", "country")[("cn", 2024, "FR")]["procedures"] == 1
    assert reports.field_matrix(coverage, [2024]).count() == 8
    assert reports.export_coverage(tables["raw_calls"], "cn", "ID_NOTICE_CN", "VALUE_EURO_FIN_1").count() == 5
    assert reports.code_audit(tables["notice_all"], "procedure").count() >= 2
    assert reports.page_winners(tables["notice_api"]).first()["cross_border"] == 0.0


def test_function_reports(spark, tables):
    code_map = spark.createDataFrame([("33100000", "07", "unanimous"), ("72000000", "BD", "contested (<=50%)")], "cpv string, consensus string, band string")
    panel = reports.function_panel(tables["notice_all"], code_map)
    rows = {(r["type"], r["country"], r["function"], r["function_source"]): r["procedures"] for r in panel.collect()}
    assert rows[("can", "FR", "07", "product")] == 1 and rows[("can", "FR", "01", "buyer")] == 1
    yearly = reports.function_shares(panel)
    assert reports.dense_function_shares(yearly, [2020, 2024]).count() == 2 * 11
    stems = spark.createDataFrame([("Software", "72"), ("Hardware", "30")], "category string, stem string")
    assert {r["kind"] for r in reports.digital_procedures(tables["notice_all"], stems).collect()} == {"Software", "not ICT"}
    tags = spark.createDataFrame([("72000000", "05.1", 5)], "cpv string, secondary string, votes int")
    double = reports.double_tagging(tables["notice_all"], code_map, tags)
    assert {r["sec_div"] for r in double.collect()} == {"none", "05"}
    assert {(r["year"], r["layer"]): r["share"] for r in reports.green_layers(double).collect()}[(2024, "co_purpose")] == 1.0
    assert {r["function"]: r["tagged"] for r in reports.tagged_share(double).collect()}["01"] == 1.0
    assert _by(reports.keyword_calls(tables["notice_api"]), "month")[dt.date(2024, 5, 1)]["share"] == 1.0
    assert reports.summary(tables["notice_all"]).count() > 5
    expenditure = spark.createDataFrame([("FR", "P2", f"GF{n:02d}", "2022", float(n)) for n in range(1, 11)], "geo string, na_item string, cofog99 string, time string, values double")
    ours = spark.createDataFrame([("can", "FR", 2022, f"{n:02d}", float(n * n)) for n in range(1, 11)], "type string, country string, year int, function string, value_eur double")
    assert _by(reports.expenditure_benchmark(ours, expenditure, ["FR"]), "country")["FR"]["r"] == pytest.approx(1.0)
    assert reports.expenditure_windows(ours, expenditure, ["FR"]).count() == 3


def test_pulse_and_composition(spark, tables):
    months = [("cn", c, dt.date(2019 + i // 12, i % 12 + 1, 1), 10) for c in ("FR", "XX") for i in range(14)]
    monthly = spark.createDataFrame(months, "type string, country string, month date, procedures int")
    index = reports.pulse(monthly, ["FR"])
    assert {r["country"] for r in index.collect()} == {"ALL", "FR"} and index.filter("country = 'ALL'").agg(F.max("procedures")).first()[0] == 20
    assert reports.winner_sizes(tables["award_api"], 2024, 1, 0).count() == 0
    assert reports.buyer_types(tables["notice_all"], 2024).first()["category"] == "regional-local"
    assert reports.sme_share(tables["award"], tables["notice_can"], 2020).first()["sme_share"] == 1.0


def test_multinationals(spark, tables):
    entries = spark.createDataFrame([("Alpha", "FRA", "Alpha Travaux", "fr/123456789")], "parent string, iso3 string, sub_name string, oc string")
    headquarters = spark.createDataFrame([("Alpha", "USA")], "parent string, hq_iso3 string")
    winners, known, matches = register.match_winners(tables["award"], entries)
    assert matches.count() == 1 and winners.count() == 2 and known.count() == 1
    top = register.leading_parents(matches, headquarters).first()
    assert top["hq_iso3"] == "USA" and top["awards"] == 1
    shares = reports.multinational_shares(reports.won_by_name(tables["award"], tables["notice_can"]), matches, headquarters).first()
    assert shares["region"] == "US parent" and shares["share"] == 0.5 and shares["share_awards"] == 0.5
    ids = spark.createDataFrame([("FR", "12345678900012", 3), ("UK", "77", 1)], "country string, winner_id_norm string, awards int")
    companies = spark.createDataFrame([("FR123456789", "Build", "12", "DE1"), ("GB77", "Trade", "x", None)], "bvdid string, sector string, employees string, guo_bvdid string")
    profile = _by(register.company_profile(register.match_companies(ids, companies), "size"), "prefix")
    assert profile["FR"]["size"] == "small" and profile["GB"]["size"] is None and profile["FR"]["awards"] == 3


def test_labelling(spark, tables):
    used = labelling.used_codes(tables["notice_cn"], tables["notice_can"])
    names = spark.createDataFrame([("33100000", "Medical"), ("33000000", "Health goods"), ("33100000"[:3] + "00000", "Group"), ("72000000", "IT")], "cpv string, label_en string").dropDuplicates(["cpv"])
    nothing = spark.createDataFrame([], "cpv string")
    batch = labelling.batches_to_send(used, names, nothing).first()
    assert batch["codes"] == 1 and "division: Health goods" in batch["payload"]
    assert labelling.batches_to_send(used, names, nothing, seed=1).count() == 1
    assert labelling.batches_to_send(used, names, spark.createDataFrame([("33100000",)], "cpv string")).count() == 0
    runs = spark.createDataFrame([(f"oa_mini_v1_{v}", "72000000", label) for v, label in (("en", "BD"), ("rep", "buyer-dependent"), ("fr", "04.1"), ("shuf", "zz"))], "run string, cpv string, cofog_primary string")
    voted = labelling.code_consensus(runs, used, names).first()
    assert voted["consensus"] == "BD" and voted["votes"] == "BD:2 04:1 ??:1"
    pairs, factors = labelling.run_agreement(runs, ["oa_mini_v1_en", "oa_mini_v1_rep", "oa_mini_v1_fr", "oa_mini_v1_shuf"])
    assert pairs.count() == 6 and _by(factors, "factor")["Exact repeat (noise floor)"]["mean_agreement"] == 1.0
    shown, key = labelling.validation_sample(tables["notice_api"], labelling.code_consensus(runs, used, names), names)
    assert "consensus" not in shown.columns and key.count() == shown.count() == 5
    human = key.select("sample_id", "pub_number", F.lit("01").alias("human_div"))
    judged = labelling.judged_sample(human, key, tables["notice_all"])
    assert judged.filter("agree").count() >= 3
    by_band, by_source, headline = labelling.validation_report(judged)
    assert by_band.count() == 1 and by_source.count() == 1 and headline.first()["agreement"] is not None


def test_answers(spark):
    raw = spark.createDataFrame([(1, ["45000000"], '{"items":[{"cpv":"45000000","cofog_primary":"06"}]}')], "batch_id int, codes array<string>, answer string")
    assert labelling.answered_codes(raw).first()["cofog_primary"] == "06"


def test_rebuild_is_idempotent(spark, inputs, tables, tmp_path):
    again = build_products(spark, inputs, str(tmp_path))
    for name in ("notice_cn", "notice_can", "award", "notice_all", "award_api"):
        assert tables[name].exceptAll(again[name]).count() == 0 and tables[name].count() == again[name].count()


def test_products_hide_nothing(spark, tables):
    assert set(products.HISTORY_COLUMNS) <= set(tables["notice_all"].columns)
