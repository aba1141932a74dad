"""All queries outside the llm subpackage."""

from factweave.plans.core import CORE
from factweave.plans.domain import DOMAIN
from factweave.plans.reference import REFERENCE
from factweave.plans.registry import Registry

CATALOG = Registry()
for _part in (CORE, REFERENCE, DOMAIN):
    CATALOG.queries |= _part.queries
    CATALOG.sql |= _part.sql
