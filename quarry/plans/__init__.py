"""quarry.plans"""

from . import contract_queries, queries, question_queries, registry_queries, tender_list_queries  # noqa: E402,F401  registers the queries
