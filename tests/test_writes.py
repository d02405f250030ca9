import threading

import pytest

from docgrid.operators.versions import Conflict, Versions
from docgrid.plans.writes import WRITES, write


@pytest.fixture
def store(spark, tmp_path):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    out = Versions(spark, f"file://{tmp_path}/store")
    assert out.head() == 0 and out.tables() == {}
    first = {
        "tables": rows([("t1", "p1", 1, "t1", 1, None, None, None, None), ("t2", "p1", 2, "t1", 2, "t1", None, "c2", 0), ("t3", "p1", 3, "t3", 1, None, 1, None, 1)], "table_id string, pdf_name string, page int, head_id string, level int, parent_id string, relevancy int, correct_csv string, headers_tagged int"),
        "pdfs": rows([("p1", ""), ("p2", "")], "pdf_name string, status string"),
        "csvs": rows([("c1", "t1", "stream", None, 0), ("c2", "t2", "stream", "ok", 1), ("c3", "t1", "lattice", None, 0), ("c4", "t3", "stream", None, 0)], "csv_id string, table_id string, method string, accepted string, append_status int"),
        "table_tags": rows([("t1", 4), ("t2", 6), ("t3", 4)], "table_id string, tag_id int"),
        "header_tags": rows([("t1", 0, "date"), ("t3", 1, "issue")], "table_id string, header_idx int, htag string"),
    }
    assert out.commit(0, first) == 1
    return out


def column(store, table, key, value):
    return {r[key]: r[value] for r in store.tables()[table].collect()}


def test_every_route(store):
    assert len(WRITES) == 11
    v = write("insertTable", store, 1, table_id="t4", pdf_name="p1", page=4, parent_id="t2")
    v = write("insertTable", store, v, table_id="t5", pdf_name="p2", page=1)
    got = {r.table_id: (r.head_id, r.level) for r in store.tables()["tables"].collect()}
    assert got["t4"] == ("t1", 3) and got["t5"] == ("t5", 1)
    with pytest.raises(ValueError):
        write("insertTable", store, v, table_id="t5")
    v = write("setPdfStatus", store, v, pdf_name="p1", status="locked")
    assert column(store, "pdfs", "pdf_name", "status") == {"p1": "locked", "p2": ""}
    v = write("setValidation", store, v, table_id="t1", csv_id="c1", method="stream", is_head=True)
    assert column(store, "tables", "table_id", "correct_csv") == {"t1": "c1", "t2": "c2", "t3": None, "t4": None, "t5": None}
    v = write("setValidation", store, v, table_id="t1", csv_id=None, is_head=True)
    assert set(column(store, "tables", "table_id", "correct_csv").values()) == {None}
    v = write("setValidation", store, v, table_id="t3", csv_id="c4")
    assert column(store, "tables", "table_id", "correct_csv")["t3"] == "c4"
    v = write("tagUntagTable", store, v, table_id="t1", tag_id=9, set_=True, is_head=True)
    assert {(r.table_id, r.tag_id) for r in store.tables()["table_tags"].collect()} == {("t1", 4), ("t1", 9), ("t2", 4), ("t2", 9), ("t4", 4), ("t4", 9), ("t3", 4)}
    v = write("tagUntagTable", store, v, table_id="t2", tag_id=9, set_=False)
    v = write("setRelevancy", store, v, table_id="t1", relevancy=0, is_head=True)
    assert column(store, "tables", "table_id", "relevancy") == {"t1": 0, "t2": 0, "t3": 1, "t4": 0, "t5": None}
    assert {(r.table_id, r.tag_id) for r in store.tables()["table_tags"].collect()} == {("t3", 4)}
    v = write("setAccepted", store, v, csv_id="c1", accepted="[]")
    v = write("setAppendStatus", store, v, csv_id="c1", append_status=2)
    assert {(r.accepted, r.append_status) for r in store.tables()["csvs"].where("csv_id = 'c1'").collect()} == {("[]", 2)}
    v = write("setHeaderTaggingStatus", store, v, table_id="t3", headers_tagged=0)
    v = write("setHeaderTag", store, v, table_id="t3", header_idx=1, htag="status")
    with pytest.raises(ValueError):
        write("setHeaderTag", store, v, table_id="t3", header_idx=1, htag="status")
    v = write("removeHeaderTag", store, v, table_id="t3", header_idx=1, htag="issue")
    assert {tuple(r) for r in store.tables()["header_tags"].collect()} == {("t1", 0, "date"), ("t3", 1, "status")}
    v = write("deleteTable", store, v, table_id="t3")
    left = store.tables()
    assert left["tables"].count() == 4 and left["csvs"].count() == 3 and left["table_tags"].count() == 0 and left["header_tags"].count() == 1
    assert store.tables(1)["tables"].count() == 3 and store.head() == v  # the first version is as it was


def test_a_lost_race_changes_nothing(store, tmp_path):
    write("setPdfStatus", store, 1, pdf_name="p1", status="mine")
    with pytest.raises(Conflict):
        write("setPdfStatus", store, 1, pdf_name="p1", status="late")
    assert store.head() == 2 and column(store, "pdfs", "pdf_name", "status")["p1"] == "mine"


def test_of_writers_at_once_one_wins(store, tmp_path):
    won, lost = [], []

    def run(name):
        try:
            won.append((write("setPdfStatus", store, 1, pdf_name="p2", status=name), name))
        except Conflict:
            lost.append(name)

    threads = [threading.Thread(target=run, args=(f"w{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 3 and store.head() == 2
    assert column(store, "pdfs", "pdf_name", "status")["p2"] == won[0][1]
    assert len(list((tmp_path / "store" / "pdfs").iterdir())) == 2  # what the others wrote is gone
