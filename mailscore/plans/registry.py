"""The registered queries."""

from mailscore.plans.oracle import Registry

R = Registry()
