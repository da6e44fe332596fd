"""Population text analytics on Spark: reports, panels, coupling, trajectories, vectors, networks and their nulls."""
