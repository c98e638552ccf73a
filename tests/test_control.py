import uuid

import pytest

from hushframe.control.registry import Control
from hushframe.control.service import Service
from hushframe.errors import BudgetExhausted, Busy, Conflict, Forbidden, NotAggregate, NotFound, QueryError
from hushframe.model import DatasetSlug
from hushframe.sources.snapshots import Vault

SLUG = DatasetSlug("cohorts")
SQL = "SELECT condition, COUNT(*) AS n FROM cohorts GROUP BY condition"


@pytest.fixture
def parties():
    return uuid.uuid4(), uuid.uuid4()


@pytest.fixture
def service(spark, tmp_path, parties):
    vault = Vault(str(tmp_path))
    vault.commit(parties[0], SLUG, spark.createDataFrame([("flu", i) for i in range(6)] + [("rare", 7)], "condition string, age long"))
    return Service(spark, vault, cohort=5)


def test_budgets_only_shrink_or_rise_by_top_ups(parties):
    control = Control()
    grant = control.create_grant(*parties, SLUG)
    control.open_budget(grant.id, 2)
    control.open_budget(grant.id, 99)
    control.charge(grant.id, 2)
    with pytest.raises(BudgetExhausted):
        control.charge(grant.id)
    assert control.top_up(grant.id, 1, "a") == control.top_up(grant.id, 1, "a")
    assert control.budget_of(parties[1], grant.id).remaining == 1
    with pytest.raises(NotFound):
        control.budget_of(uuid.uuid4(), grant.id)


def test_grants(parties):
    control = Control()
    grant = control.create_grant(*parties, SLUG)
    assert control.create_grant(*parties, SLUG) == grant
    with pytest.raises(Conflict):
        control.create_grant(parties[0], parties[0], SLUG)
    for foreign in ((parties[1], grant.id), (parties[0], uuid.uuid4())):
        with pytest.raises(NotFound):
            control.revoke(*foreign)
    revoked = control.revoke(parties[0], grant.id)
    with pytest.raises(Forbidden):
        control.find_active(*parties, SLUG)
    with pytest.raises(Conflict):
        control.create_grant(*parties, SLUG, unless_revoked=True)
    assert control.create_grant(*parties, SLUG).revoked_at == revoked.revoked_at
    assert len(control.grants_for(parties[1])) == 1


def test_publish_request_approve(service, parties):
    steward, researcher = parties
    control = service.control
    with pytest.raises(NotFound):
        control.publish(steward, DatasetSlug("other"), "x", service.vault.held(steward))
    listing = service.publish(steward, "cohorts", "Cohorts")
    assert service.publish(steward, "cohorts", "Again").id == listing.id
    with pytest.raises(Conflict):
        control.request(steward, listing.id)
    request = control.request(researcher, listing.id)
    assert control.request(researcher, listing.id) == request
    with pytest.raises(NotFound):
        control.resolve(researcher, request.id, True, 1)
    grant = control.resolve(steward, request.id, True, 2)
    assert control.resolve(steward, request.id, True, 2) == grant and control.budgets[grant.id].limit == 2
    with pytest.raises(Conflict):
        control.resolve(steward, request.id, True, 3)
    more = control.request(researcher, listing.id)
    control.resolve(steward, more.id, True, 5)
    assert control.budgets[grant.id].limit == 7
    denied = control.request(uuid.uuid4(), listing.id)
    control.resolve(steward, denied.id, False)
    with pytest.raises(NotFound):
        control.resolve(steward, denied.id, True, 1)
    control.unpublish(steward, listing.id)
    assert control.browse() == []
    with pytest.raises(NotFound):
        control.request(researcher, listing.id)


def test_research_queries_are_gated_charged_and_audited(service, parties):
    steward, researcher = parties
    with pytest.raises(Forbidden):
        service.research_query(researcher, steward, "cohorts", SQL)
    grant = service.control.create_grant(steward, researcher, SLUG)
    service.control.open_budget(grant.id, 2)
    out = service.research_query(researcher, steward, "cohorts", SQL)
    assert (out["rows"], out["suppressed_rows"], out["budget_remaining"]) == ([{"condition": "flu", "n": 6}], 1, 1)
    with pytest.raises(QueryError):
        service.research_query(researcher, steward, "cohorts", "SELECT * FROM cohorts")
    with pytest.raises(BudgetExhausted):
        service.research_query(researcher, steward, "cohorts", SQL)
    assert not any("SELECT" in str(x) for x in service.audit) and service.metrics["research_refused"] == 3


def test_own_queries(service, parties):
    steward = parties[0]
    assert service.query(steward, "cohorts", SQL)["row_count"] == 1
    assert service.query(steward, "cohorts", "SELECT * FROM cohorts", zero_knowledge=False)["row_count"] == 7
    with pytest.raises(NotAggregate):
        service.query(steward, "cohorts", "SELECT * FROM cohorts")
    assert service.query(uuid.uuid4(), "cohorts", SQL)["rows"] == []
    service._slots = None
    with pytest.raises(Busy):
        service.query(steward, "cohorts", SQL)
