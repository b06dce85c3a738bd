"""Jobs wired from operators: training, scoring and the registered queries."""
