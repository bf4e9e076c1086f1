"""Test-table views, the query catalogue and its SQL counterparts."""
