"""Writers: the ledger and the reports made from it."""
