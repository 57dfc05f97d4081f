from tablecheck.example import FILES
from tablecheck.model import ParityOptions
from tablecheck.operators import parity
from tablecheck.operators.verdict import assess
from tablecheck.sources.files import load_table


def test_example_from_file_to_verdict(spark, tmp_path):
    sides = []
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
        sides.append(load_table(spark, f"file://{tmp_path / name}").df)
    spec, meta = parity.make_spec(*sides, ["customer_id"])
    result = parity.run_parity(*sides, spec, meta)
    assert {c.pair.source: c.mismatches for c in result.columns} == {"name": 1, "email": 2, "country": 1, "lifetime_value": 1, "signup_date": 0}
    assert (result.keys.matched, result.keys.only_source, result.keys.only_target) == (11, 1, 1) and result.unpaired_target == ["loaded_at"]
    relaxed = ParityOptions(trim=True, ignore_case=True, empty_as_null=True, tolerance=0.01)
    spec, meta = parity.make_spec(*sides, ["customer_id"], relaxed)
    result = parity.run_parity(*sides, spec, meta)
    assert {c.pair.source: c.mismatches for c in result.columns if c.mismatches} == {"country": 1}
    found = assess(result, relaxed)
    assert found.verdict == "differs" and any("Relaxed comparison" in g for g in found.gaps)
    only, _ = parity.make_spec(*sides, ["customer_id"], relaxed, exclude=("country",))
    same = sides[0].where("customer_id < 512")
    matching = parity.run_parity(same, sides[1].where("customer_id < 512"), only, {"excluded": ["country"]})
    assert assess(matching, relaxed).verdict == "match-with-gaps"
