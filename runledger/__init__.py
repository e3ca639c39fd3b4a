"""runledger: build and test reports to a queryable ledger, as Spark jobs."""

__version__ = "0.1.0"
