"""Campaign notifications on Spark.

Restaurants publish short campaigns; every user who marked the restaurant as a
favourite gets one notification per campaign message while the campaign runs.
"""
