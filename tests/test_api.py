from locusforge.api import EvidenceAPI
from locusforge.operators import locus as L
from locusforge.operators import tables as TB
from locusforge.plans.build import write_tables
from locusforge.session import scratch_path


def test_api_from_stored_tables(spark, ds):
    paths = write_tables(ds.raw, ds.genes, ds.lead_variant, scratch_path(spark, "api-tables"))
    api = EvidenceAPI.from_tables(spark, paths)
    out = api.locus("7", 3000000, 12000000, g2VScore=[0.2, 0.6], selectedId="ENSG137",
                    selectedType="gene")
    direct = L.locus(ds.processed, ds.genes, L.Locus("7", 3000000, 12000000))
    assert sorted(r.id for r in out["genes"].collect()) == sorted(r.id for r in direct["genes"].collect())
    assert out["maxGwasPValue"].first()[0] == direct["maxGwasPValue"].first()[0]
    page = api.locusTable("7", 3000000, 12000000, offset=0, limit=10)
    assert page["rows"].count() == 10 and page["total"].first().total == 181
    d = api.diseaseTable("EFO_7", 0, 5)
    assert d["rows"].count() == 5
    first = api.diseaseTable("EFO_7", after=None, offset=0, limit=5)["rows"].collect()
    deep = api.diseaseTable("EFO_7", offset=5, limit=5)["rows"].collect()
    last = api.locusTable("7", 3000000, 12000000, offset=0, limit=5)["rows"]
    nxt = api.locusTable("7", 3000000, 12000000, offset=5, limit=5)["rows"].collect()
    rows = L.window_rows(api.layout, "7", 3000000, 12000000)
    key = TB.cursor(TB.keyset_page(rows, None, 5).collect()[-1])
    by_key = api.locusTable("7", 3000000, 12000000, limit=5, after=key)["rows"].collect()
    assert [r["index"] for r in by_key] == [r["index"] for r in nxt]
    assert len(first) == 5 and len(deep) == 5 and last.count() == 5
    rest = api.locusTable("7", 3000000, 12000000, after=key)["rows"]
    assert rest.count() == 181 - 5                                     # no limit: all of them
    assert api.locusTable("7", 3000000, 12000000, limit=0, after=key)["rows"].count() == 0
    sort = ["-gwasPValue"]
    page = api.diseaseTable("EFO_7", limit=5, sort=sort, after=())["rows"].collect()
    more = api.diseaseTable("EFO_7", limit=5, sort=sort, after=TB.cursor(page[-1], sort))["rows"].collect()
    whole = api.diseaseTable("EFO_7", limit=10, sort=sort)["rows"].collect()
    assert [r["index"] for r in page + more] == [r["index"] for r in whole]
    held = api.locus("7", 3000000, 12000000, cache=True)
    assert held["genes"].count() and held.window.storageLevel.useMemory
    window = held.window
    held.release()
    assert held.window is None and not window.storageLevel.useMemory
    assert api.geneLocation("ENSG137").count() == 1
    assert api.search("rs549").count() in (0, 1)
    assert api.variantLocation("nope").count() == 0
