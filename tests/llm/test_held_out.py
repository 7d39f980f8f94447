import os
import sys

import pyarrow.parquet as pq

from tributary.llm import names_public, pii

sys.path.insert(0, os.path.dirname(__file__))
import labels  # noqa: E402


def recall(d):
    """(names put in, found exactly, names given out that are none of them) over the documents of ``d``."""
    n = pii.Names()
    total = hit = extra = 0
    for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        if not r["text"]:
            continue
        text, names = labels.with_other_names(r["text"], r["doc_id"])
        found = [text[a:b] for a, b, k in pii.find(text, n) if k == "name"]
        total += len(names)
        hit += sum(x in found for x in names)
        extra += sum(x not in names for x in found)
    return total, hit, extra


def test_names_that_no_list_has():
    assert not {x.lower() for x in labels.OTHER_GIVEN} & names_public.GIVEN and not {x.lower() for x in labels.OTHER_FAMILY} & names_public.FAMILY
    total, hit, extra = recall(os.environ.get("TEST_HELD_OUT_DIR", "/root/testdata/sf0.01"))
    assert total > 200 and hit >= 0.9 * total and extra <= 0.1 * total, (total, hit, extra)


def test_free_forms():
    n = pii.Names()
    one = lambda t: [(t[a:b], k) for a, b, k in pii.find(t, n)]
    for t, want in [
        ("Assigned to John Smith, due in 3 h.", ("John Smith", "name")), ("Signed for by Priya Patel at 10:00", ("Priya Patel", "name")), ("Mit freundlichen Grüßen\nHans Schmidt\n", ("Hans Schmidt", "name")),
        ("Contact: Sarah O'Neill, +44 20 7946 0114", ("Sarah O'Neill", "name")), ("caller: Wei Zhang", ("Wei Zhang", "name")), ("Frau maria kowalczyk bittet um Rückruf", ("maria kowalczyk", "name")),
        ("passport X1234567 was shown", ("X1234567", "id_number")), ("Ship it to 14 Church Road, Leeds LS1 4AP.", ("14 Church Road, Leeds LS1 4AP", "address")), ("Send to 12 Baker Street, Springfield 12345, please", ("12 Baker Street, Springfield 12345", "address")),
        ("Lieferung an Hauptstraße 5, 10115 Berlin Bitte klingeln.", ("Hauptstraße 5, 10115 Berlin", "address")), ("au nom de Camille Lefebvre Retour à 2.1", ("Camille Lefebvre", "name")),
    ]:
        assert want in one(t), (t, one(t))
    for t in ("Assigned to the Support Team, due in 3 h.", "The Monday Report for Sales Data is late.", "Order 44 20 7946 0114 was split", "Bitte das Paket am Montag liefern.", "as of 5 May the lane road map is done"):
        assert not [x for x in one(t) if x[1] in ("name", "address")], (t, one(t))
