"""Sentences to plans: what is understood, what needs a mapping, what is refused."""

import pytest

from rowsentry.plans.compiler import compile_rules
from rowsentry.plans.gate import DeterministicGate, PredictorGate, admit
from rowsentry.plans.language import SourceRule, interpret, metadata, parse_rules

#: Own sentences, one or more for each shape that the language has.
UNDERSTOOD = [
    ("Bin Number is required", ["Bin Number"], "required"),
    ("the Dock field must not be empty", ["Dock"], "required"),
    ("Dock can't be null.", ["Dock"], "required"),
    ("could you verify that Lot Code has data", ["Lot Code"], "required"),
    ("search for blank values in Lot Code", ["Lot Code"], "required"),
    ("I would like you to check that `Pallet` is filled in", ["Pallet"], "required"),
    ("confirm Pallet needs to be provided", ["Pallet"], "required"),
    ("Identify rows where Dock is not populated or Pallet is not populated", ["Dock", "Pallet"], "required:any"),
    ("Either Dock or Pallet must have a value", ["Dock", "Pallet"], "required:all"),
    ("Report records with Dock absent and Pallet absent", ["Dock", "Pallet"], "required:all"),
    ('When "Carrier" equals "Rail", "Wagon" must be populated.', ["Carrier", "Wagon"], "required"),
    ('If Carrier is "Road" or Carrier is "Rail", then Weight should be numeric', ["Carrier", "Weight"], None),
    ('For Carrier in "Road", "Sea", "Seal Number" must start with "S"', ["Carrier", "Seal Number"], "value_check"),
    ("detect duplicates in Seal Number", ["Seal Number"], "duplicate_fields"),
    ("Seal Number and Lot Code must not repeat", ["Seal Number", "Lot Code"], "duplicate_fields"),
    ("the same Seal Number appears on more than one record", ["Seal Number"], "unique_any"),
    ("Loaded At equals Shipped From", ["Loaded At", "Shipped From"], "same_fields"),
    ("Driver, Co-Driver and Owner are not all equal", ["Driver", "Co-Driver", "Owner"], "same_fields"),
    ("Find malformed emails", ["Email"], "validation"),
    ("Depot Mail must be a valid e-mail", ["Depot Mail"], "format"),
    ("Depot Code must be a valid ZIP+4", ["Depot Code"], "format"),
    ("Weight must be a number", ["Weight"], "validation"),
    ("Loaded On must be a valid date", ["Loaded On"], "validation"),
    ("'Label' should contain 'FRAGILE', case-insensitive", ["Label"], "value_check"),
    ('"Label" must not end with "-old"', ["Label"], "value_check"),
    ('"Lane" must be one of "A", "B" or "C"', ["Lane"], "value_check"),
    ('"Height" must be between 0.5 and 2', ["Height"], "value_check"),
    ('The worksheet must contain columns "Lane" and "Wharf"', ["Lane"], "columns_exist"),
    ("find repeated records using Seal Number", ["Seal Number"], "duplicate"),
    ("Find duplicate Driver with 85% similarity", ["Driver"], "duplicate"),
    ("The same Seal Number can't have different Carrier", ["Seal Number", "Carrier"], "consistency"),
]
REFUSED = [
    "The warehouse ought to be tidy.", "Never report missing Dock", "List rows where Dock is filled", "Dock should remain blank", "Dock must not be provided", "Return records with non-empty Dock",
    "Dock must not be empty only when Carrier is Rail", "Remove records without Dock", "Automatically merge equal rows", "Compare Dock against the port directory", "Carrier must be in the external file",
    '"Height" must be between 9 and 2.', '"Label" must contain "x" and "y".', '"Label" must start with "".', "Loaded On must be after Shipped On.", "Weight must be greater than 4", "Label must match the regex A+",
]


def test_states():
    from rowsentry.plans.language import Refused, symbols

    for helper, object_, symbol in [("is", "blank", "BLANK"), ("is not", "blank", "PRESENT"), ("isn't", "missing", "PRESENT"), ("must not be", "null", "PRESENT"), ("must be", "filled in", "PRESENT"), ("does not", "exist", "BLANK"), ("has", "a value", "PRESENT"), ("are", "mandatory", "PRESENT"), ("aren't", "provided", "BLANK"), ("needs to", "exist", "PRESENT")]:
        assert symbols(f"F0Q0 {helper} {object_}") == f"F0Q0 {symbol}", helper
    assert symbols("missing F0Q0") == "MISSING F0Q0" and symbols("F0Q0 is not required") == "F0Q0 is not required"
    for text in ("F0Q0 must be blank", "F0Q0 may not have a value", "F0Q0 shouldn't be present"):
        with pytest.raises(Refused):
            symbols(text)


def read(text, headers, **kw):
    return interpret(SourceRule("r", text), {h: h for h in headers}, **kw)


@pytest.mark.parametrize("text,headers,kind", UNDERSTOOD)
def test_understood(text, headers, kind):
    it = read(text, headers)
    if kind is None:  # a scope that this check can't take
        assert it.status == "unsupported"
        return
    plan = compile_rules([it]).rules[0].plan
    assert it.status == "valid" and plan is not None, it.warnings
    got = plan.check.kind + (f":{plan.check.mode}" if ":" in kind else "") if plan.check else plan.kind
    assert got == kind


@pytest.mark.parametrize("text", REFUSED)
def test_refused(text):
    it = read(text, ["Dock", "Carrier", "Height", "Label", "Loaded On", "Shipped On", "Weight"])
    assert it.status == "unsupported"
    assert not compile_rules([it]).can_run


def test_binding():
    assert read('"Email" must not be blank.', ["Email Address", "E-mail"]).status == "needs_mapping"
    assert read('"Tax ID" is required.', ["Other"]).status == "needs_mapping"
    assert read('"Tax ID" is required.', ["Other"], mapping={"Tax ID": "Other"}).status == "valid"
    assert read('"Tax ID" is required.', ["Tax ID"], mapping={"Tax ID": "gone"}).status == "needs_mapping"


def test_metadata():
    assert metadata('"A" is required. Priority: Low / Medium. Action: Route to X.') == ('"A" is required.', "low_medium", "Route to X.")
    text, priority, action = metadata("If A is blank, flag a high-priority issue and route it to the Desk for repair.")
    assert (priority, action) == ("high", "route it to the Desk for repair.")


def test_sources():
    rules = parse_rules("- A is required\n- **B** must be unique\n")
    assert [r.text for r in rules] == ["A is required", "B must be unique"]
    assert parse_rules("one\n\ntwo lines\nhere")[1].text == "two lines here"
    assert rules[0].id.startswith("rule-1-") and len({r.id for r in rules}) == 2


def test_weighted_needs_configuration():
    text = "Flag duplicate customers with similar names, addresses and postal codes"
    headers = ["Name", "Address", "Postal code"]
    it = read(text, headers)
    assert it.status in ("needs_configuration", "unsupported")
    ready = read(text, headers, configuration={"similarity": {"threshold": 0.9, "weights": {"Name": 0.5, "Address": 0.3, "Postal code": 0.2}}})
    assert ready.status == ("valid" if it.status == "needs_configuration" else "unsupported")


def test_gate():
    its = [read("Fax is required", ["Fax"])]
    assert admit(its, DeterministicGate())[0].status == "valid"
    assert admit(its, PredictorGate(lambda text, question: (True, 0.79, False)))[0].status == "unsupported"


def test_self_test():
    from rowsentry.plans.gate import self_test

    assert self_test(DeterministicGate())[0].approved
