"""Circuit-graph analytics and dataset pipelines as DataFrame operators."""
