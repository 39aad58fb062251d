"""All named queries."""

from loanloom.queries import features, models, requests, rules

QUERIES = {**features.QUERIES, **rules.QUERIES, **requests.QUERIES, **models.QUERIES}
