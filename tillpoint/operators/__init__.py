"""DataFrame operators: ledger, dashboards, reports, mutations, checkout, quality, audit."""
