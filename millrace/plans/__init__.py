"""Business plans: facts, marts, measures, audits and the query registry."""
