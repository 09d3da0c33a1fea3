"""Message-safety analytics on PySpark: screening, policy, counters, metrics and rule packs."""
