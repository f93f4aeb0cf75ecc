"""Multi-step jobs: version catalogue, experiment sweep, evaluation chain and the registered queries."""
