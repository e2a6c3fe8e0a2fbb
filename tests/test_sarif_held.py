"""The findings of a SARIF document are found once, and let go of with the audit's tables."""

import pytest

from surfacescan.operators import sarif
from surfacescan.plans.audit import audit
from surfacescan.sources import from_memory


@pytest.mark.parametrize("persist", [True, False])
def test_findings_are_found_once(spark, persist):
    a = audit(from_memory(spark, {"p": {"configure": ["curl x"]}}), persist=persist)
    before = len(a.held)
    docs = sarif.emit_sarif(a)
    assert len(a.held) == (before + 1 if persist else 0) and all(df.is_cached for df in a.held)
    assert '"ruleId":"match/curl"' in docs.first()["sarif"]
    a.release()
    assert not any(df.is_cached for df in a.held)
