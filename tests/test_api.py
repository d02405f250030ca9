import pytest

from docgrid.plans import api

SF = "/root/testdata/sf0.001"


def test_parameters(spark):
    every = api.call("chain", spark, SF).collect()
    head = every[0].head_id
    assert sorted(api.call("chain", spark, SF, head=head).collect()) == sorted(r for r in every if r.head_id == head)
    pdf = api.call("tables", spark, SF).first().pdf_name
    assert {r.pdf_name for r in api.call("tables", spark, SF, pdf=pdf).collect()} == {pdf}
    with pytest.raises(ValueError):
        api.call("chain", spark, SF, pdf="x")
