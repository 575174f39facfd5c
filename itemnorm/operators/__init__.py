"""Table operators: similarity joins, clustering, voting, decisions, enrichment and reports."""
