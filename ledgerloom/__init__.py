"""Bank-ledger import, identification, labelling and review export on Spark."""
