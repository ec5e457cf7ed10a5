"""Road-traffic analytics over fiber-optic strain sensing, as Spark DataFrame operators."""
