from wagetide.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_descriptions_that_occur_once_are_kept(spark):
    got = {r["text"]: r["n"] for r in QUERIES["v_descriptions"](spark, SF).collect()}
    accepted = QUERIES["v_row_status"](spark, SF).filter("status = 'accepted'").count()
    assert sum(got.values()) == accepted and len(got) > 100 and got["__EMPTY__"] > 1
