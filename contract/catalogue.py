"""All registered queries."""

from contract import assemble, copula, evaluate, flows, marginals, prep, written  # noqa: F401
from contract.registry import QUERIES, SQL  # noqa: F401
