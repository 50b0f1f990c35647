"""The registered queries: importing the modules fills ``registry``."""

from vellum.plans import evaluation, indexes, logs, records, relational, retrieval, text
from vellum.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "evaluation", "indexes", "logs", "records", "relational", "retrieval", "text"]
